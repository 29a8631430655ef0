"""Ranked lexical search: an Aho-Corasick automaton of all items' terms scans whole texts (operator 13).

No index of documents is built. The terms of all items make one automaton; a term stands between guards in it, and so do the words
of a folded text, in which every separator is a guard: what matches is a whole term. The automaton is sent to all tasks. The first scan counts
documents, words and the documents that hold each term; with these, which are as many numbers as terms, the second scan counts
the terms again in each text, weighs them and adds them up item by item: a term's output leads to the items that ask for it.
A task keeps the best of each item only, so that items times tasks rows are shuffled, whatever the documents.

Items that have more than MOST_TERMS words together are answered in blocks, with two scans each, so what is broadcast is bounded.

Defined results: a null text, or one without terms, is no document of the collection; a document's row counts for itself, so a repeated row has a
rank of its own; among equal scores rows without doc_id come last; items of equal item_id are one item, with the terms of all their texts;
items without item_id are one item likewise; an item without terms, or of terms that no document holds, has no rows; empty tables give no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import name, slices, table, whole

# The query's contract.
TOP, UNIT, SCALE, LENGTH_PERCENT, SATURATION = 10, 1_000_000_000, 1_000, 75, 8
#: Words of the items that are answered with one automaton.
MOST_TERMS = 1_000_000
#: Scores that a task holds before it drops those that are not among an item's best.
HELD = 1 << 20
GUARD = b" "
_LETTERS = (string.ascii_letters + string.digits).encode()
#: Bytes as they are folded: letters in lower case, digits, all that is not ASCII; the rest is a guard.
FOLD = bytes(ord(chr(b).lower()) if b in _LETTERS else b if b > 127 else GUARD[0] for b in range(256))


def folded(text: str) -> bytes:
    return GUARD + text.encode().translate(FOLD) + GUARD


class Terms:
    """The automaton of the items' terms, and which items ask for a term, how often."""

    def __init__(self, texts: list[str]):
        import ahocorasick

        asked = [Counter(folded(t).split(GUARD)) for t in texts]
        self.terms = sorted({w for words in asked for w in words if w})
        number = {w: i for i, w in enumerate(self.terms)}
        self.automaton = ahocorasick.Automaton()
        for w, i in number.items():
            self.automaton.add_word((GUARD + w + GUARD).decode(), i)
        if number:
            self.automaton.make_automaton()
        rows = sorted((number[w], item, n) for item, words in enumerate(asked) for w, n in words.items() if w)
        term, self.item, self.times = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def scan(self, text: str) -> tuple[int, Counter]:
        """The number of the text's words, and term -> its occurrences."""
        row = folded(text)
        guard = np.frombuffer(row, np.uint8) == GUARD[0]
        n = int(np.count_nonzero(guard[:-1] & ~guard[1:]))
        return n, Counter(map(itemgetter(1), self.automaton.iter(row.decode()))) if n and self.terms else Counter()


_TERMS: dict[str, Terms] = {}


def _terms(texts: Broadcast) -> Terms:
    """One per Python worker, for the (key, texts) of a block of items."""
    key, of = texts.value
    if key not in _TERMS:
        _TERMS.clear()
        _TERMS[key] = Terms(of)
    return _TERMS[key]


def collection(docs: DataFrame, texts: Broadcast) -> tuple[int, int, dict[int, int]]:
    """Documents with words, all their words, and for each term of the items the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n_docs, n_words = _terms(texts), 0, 0
        holding = np.zeros(len(terms.terms), np.int64)
        for part in slices(batches):
            for text in part.column("text"):
                n, tf = terms.scan(text.as_py())
                n_docs, n_words = n_docs + (n > 0), n_words + n
                holding[list(tf)] += 1
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n_docs, n_words], holding[some]]))], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of the items, at most
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-2, 0), found.pop(-1, 0), found


def weights(n_docs: int, holding: dict[int, int], n_terms: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(n_terms)], np.int64)


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best: greatest score, then smallest doc, where doc is a number by which all are told apart."""
    order = np.lexsort((doc, -score, item))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(item[order]) > 0]))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def answer(docs: DataFrame, texts: Broadcast, items: list, k: int) -> DataFrame:
    """item, doc_id, score: of each task the k best documents of each item (its number)."""
    n_docs, n_words, holding = collection(docs, texts)
    nobody = np.iinfo(np.int64).max

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _terms(texts)
        weight = weights(n_docs, holding, len(terms.terms))
        floor = np.zeros(len(items), np.int64)  # of items with k documents the least of their scores
        item, doc, value, null = ([np.empty(0, np.int64)] for _ in range(4))
        held = 0

        def shrink() -> None:
            nonlocal item, doc, value, null, held
            i, d, v, o = (np.concatenate(x) for x in (item, doc, value, null))
            best = best_of(i, np.where(o == 1, nobody, d), v, k)
            i, d, v, o = i[best], d[best], v[best], o[best]
            full = np.bincount(i, minlength=len(items)) >= k
            least = np.full(len(items), nobody)
            np.minimum.at(least, i, v)
            floor[full] = least[full]
            item, doc, value, null, held = [i], [d], [v], [o], len(i)

        for part in slices(batches):
            numbers = part.column("doc_id")
            own, tfs, terms_of, sizes = [], [], [], []
            for row, text in enumerate(part.column("text")):
                n, tf = terms.scan(text.as_py())
                own += [row] * len(tf)
                tfs += tf.values()
                terms_of += tf
                sizes.append(n)
            if not own:
                continue
            own, tf, term = np.array(own), np.array(tfs, np.int64), np.array(terms_of, np.int64)
            m = (100 - LENGTH_PERCENT) + LENGTH_PERCENT * np.array(sizes, np.int64) * n_docs // max(n_words, 1)
            points = weight[term] * (UNIT * tf // (SCALE * tf + SATURATION * m[own]))
            # every term leads to its items
            many = terms.first[term + 1] - terms.first[term]
            place = np.repeat(terms.first[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            total = np.zeros(part.num_rows * len(items), np.int64)
            np.add.at(total, np.repeat(own, many) * len(items) + terms.item[place], np.repeat(points, many) * terms.times[place])
            total = total.reshape(part.num_rows, len(items))
            row, at = np.nonzero((total > 0) & (total >= floor))
            item.append(at)
            value.append(total[row, at])
            null.append(numbers.is_null().to_numpy(zero_copy_only=False)[row].astype(np.int64))
            doc.append(numbers.fill_null(0).to_numpy(zero_copy_only=False)[row])
            held += len(row)
            if held > HELD:
                shrink()
        shrink()
        yield pa.RecordBatch.from_arrays([pa.array(item[0]), pa.array(doc[0], mask=null[0] == 1), pa.array(value[0])], ["item", "doc_id", "score"])

    return docs.mapInArrow(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(name(text_col)).alias("text")).filter("text IS NOT NULL")
    asked = items.select(F.col(name(item_col)).alias("item_id"), whole(name(item_text_col)).alias("text"))
    size = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n_blocks = -(-(asked.agg(F.sum(size)).first()[0] or 0) // most_terms)
    found = None
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).groupBy("item_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).collect()  # about most_terms words
        if rows:
            numbered = F.broadcast(spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], items.select(F.lit(0).cast("long").alias("item"), F.col(name(item_col)).alias("item_id")).schema))
            part = answer(docs, spark.sparkContext.broadcast((uuid.uuid4().hex, [r["text"] for r in rows])), rows, k).join(numbered, "item").drop("item")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = asked.limit(0).select("item_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score"))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), {_TERM})"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS t FROM documents), total AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, doc_id, len(t), term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark), i AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, sum(times * floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * total.n) // l))))::BIGINT AS score FROM i JOIN tf USING (term) JOIN df USING (term), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
