"""A stored positional index over titles and bodies: ranked search that reads its words' lists alone, and headlines by minimal covers.

A row of the index is a word in a block of documents that were read together: for each document how many positions it has, how many of them are the
title's, and the positions, title first, one document after the other. Rows are dealt into folders by a checksum of the word and, within, into files by
block, sorted by (word, block): a query reads the folders of its words, and of their files the row groups that hold them; a word that most documents
have is spread over many files. Nothing is gathered by word.

The rank of one word adds 1/k^2 over its positions, the best weighted one first; of several words it joins, over all pairs of
positions of different words, the chance that neither is by accident there: near pairs count nearly in full, pairs over NEAR words apart
(which would add less than 1e-14) not at all. Titles weigh 1.0, bodies 0.4.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rank's weights and the form of headlines.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
NEAR = 100
FRAGMENTS, LEAST_WORDS, MOST_WORDS, SHORT_WORD = 2, 8, 30, 2
MARKS, BETWEEN = ("<b>", "</b>"), " ... "
WORD, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
BUCKETS = 64
#: About so many bytes of text are a block.
BLOCK_BYTES = 8 << 20
ROW = "term string, docs array<long>, in_title array<int>, sizes array<int>, positions array<int>"
SCHEMA = f"bucket int, {ROW}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def words_of(texts: pa.Array) -> pa.ListArray:
    """The same as words() of texts in lower case, a batch at a time; null for a text without words."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(texts, NO_WORD, " "), " ")
    return pc.split_pattern(pc.if_else(pc.equal(spaced, ""), pa.scalar(None, spaced.type), spaced), " ")


def query_words(query: str) -> list[str]:
    """Different words of a query, in order."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def bucket(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The index's rows of documents (doc_id, title, body); made where the text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BLOCK_BYTES // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                listed = words_of(part.column("text"))
                flat = listed.flatten().dictionary_encode()
                if not len(flat):
                    continue
                lengths, n_title = (pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False) for x in (listed, words_of(part.column("title"))))
                code, row = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
                order = np.argsort(code * len(lengths) + row, kind="stable")  # places stay in order
                code, row, place = code[order], row[order], place[order].astype(np.int32)
                starts = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(row, prepend=-1))  # of each document's positions of a word
                first = np.flatnonzero(np.diff(code[starts], prepend=-1))  # of each word's documents
                ends, sizes = np.append(first, len(starts)).astype(np.int32), np.diff(np.append(starts, len(place))).astype(np.int32)
                title = place <= n_title[row]
                of_word = lambda values: pa.ListArray.from_arrays(pa.array(ends), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    flat.dictionary.take(pa.array(code[starts[first]])), of_word(part.column("doc_id").take(pa.array(row[starts]))), of_word(pa.array(np.add.reduceat(title, starts, dtype=np.int32))), of_word(pa.array(sizes)),
                    pa.ListArray.from_arrays(pa.array(np.append(starts[first], len(place)).astype(np.int32)), pa.array(place))], ["term", "docs", "in_title", "sizes", "positions"])

    title, body = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "body"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), title.alias("title"), F.concat_ws(" ", title, body).alias("text"))
    return texts.mapInArrow(run, ROW).select((F.crc32(F.col("term").cast("binary")) % buckets).cast("int").alias("bucket"), "*")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of documents (doc_id, title, body) to a new folder. A doc_id names one document.

    A bucket is dealt to as many tasks as there are shuffle partitions for it, by block, so that a word that most documents have is split.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, partitions // buckets)
    rows = postings(docs, buckets).repartition(max(partitions, min(buckets, 8)), "bucket", F.pmod(F.xxhash64(F.col("docs")[0]), F.lit(slices)))
    rows.sortWithinPartitions("bucket", "term", F.col("docs")[0]).write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def opened(lists: DataFrame) -> DataFrame:
    """no, doc_id, in_title, positions of rows (no, docs, in_title, sizes, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, docs, in_title, sizes, positions = batch.columns
            offsets = np.append(0, np.cumsum(sizes.flatten().to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(no.to_numpy(), docs.value_lengths().to_numpy())), docs.flatten(), in_title.flatten(), pa.ListArray.from_arrays(pa.array(offsets), positions.flatten())], ["no", "doc_id", "in_title", "positions"])

    return lists.mapInArrow(run, "no int, doc_id long, in_title int, positions array<int>")


def matches(index: DataFrame, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """doc_id, found: documents with all words; found has (no, in_title, positions) of each word, in the query's order."""
    lists = index.filter(F.col("bucket").isin(sorted({bucket(t, buckets) for t in terms})) & F.col("term").isin(*terms))
    no = F.array_position(F.array(*map(F.lit, terms)), F.col("term")).cast("int")
    each = opened(lists.select(no.alias("no"), "docs", "in_title", "sizes", "positions"))
    found = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "in_title", "positions"))).alias("found"))  # a row for each word
    return found.filter(F.size("found") == len(terms))


def rank_of(lists: Sequence[np.ndarray], in_title: Sequence[int]) -> float:
    """Rank of one document; the words' sorted positions, of which the first in_title are the title's."""
    weights = [np.where(np.arange(len(p)) < n, TITLE_WEIGHT, BODY_WEIGHT) for p, n in zip(lists, in_title, strict=True)]
    if len(lists) == 1:
        w, k = weights[0], np.arange(1, len(lists[0]) + 1)
        best = int(np.argmax(w))
        return float((w[best] + (w / k**2).sum() - w[best] / (best + 1) ** 2) / (np.pi**2 / 6))
    log = 0.0
    for (a, v), (b, w) in combinations(zip(lists, weights, strict=True), 2):
        first, last = np.searchsorted(a, b - NEAR), np.searchsorted(a, b + NEAR, "right")
        many = last - first
        other = np.repeat(np.arange(len(b)), many)
        one = np.arange(len(other)) - np.repeat(np.cumsum(many) - many - first, many)
        distance = np.abs(a[one] - b[other])
        log += np.log1p(-np.sqrt(v[one] * w[other] / (1.005 + 0.05 * np.exp(distance / 1.5 - 2)))).sum()
    return float(-np.expm1(log))


def ranked(found: DataFrame) -> DataFrame:
    """doc_id, rank of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = [rank_of([np.array(w["positions"]) for w in row], [w["in_title"] for w in row]) for row in (x.as_py() for x in batch.column("found"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranks, pa.float64())], ["doc_id", "rank"])

    return found.mapInArrow(run, "doc_id long, rank double")


def search(index: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, rank of the documents with all words of the query; a query without words finds nothing (it is for browsing)."""
    terms = query_words(query)
    if not terms:
        return index.select(F.explode("docs").alias("doc_id"), F.lit(0.0).alias("rank")).limit(0)
    return ranked(matches(index, terms, buckets))


def covers(lists: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """Minimal windows (first, last) that hold a position of every list: none has another within. One sweep over the merged lists."""
    place = np.concatenate(lists)
    which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(place)
    seen = np.full(len(lists), -1)
    out: list[tuple[int, int]] = []
    for p, w in zip(place[order].tolist(), which[order].tolist(), strict=True):
        seen[w] = p
        first = int(seen.min())
        if first > (out[-1][0] if out else 0):  # else the window before has its first word too, and ends sooner
            out.append((first, p))
    return out


def fragment(first: int, last: int, n: int) -> tuple[int, int]:
    """The words shown for a cover of a text of n words: stretched on both sides to MOST_WORDS, or its first MOST_WORDS."""
    if last - first + 1 >= MOST_WORDS:
        return first, first + MOST_WORDS - 1
    start = max(1, first - (MOST_WORDS - (last - first + 1)) // 2)
    end = min(n, start + MOST_WORDS - 1)
    return max(1, end - MOST_WORDS + 1), end


_CHUNK = re.compile(r"(\w+)(\W*)")


def headline_of(text: str, lists: Sequence[np.ndarray], terms: frozenset[str]) -> str:
    """Up to FRAGMENTS fragments of a text, around its shortest covers (the first of equals), in order of the text, with the terms marked.

    Short words at a fragment's ends that are no terms go, if LEAST_WORDS are left. Lists are the terms' positions in the text; without
    a cover its first LEAST_WORDS words are shown.
    """
    chunks = _CHUNK.findall(text)
    chosen: list[tuple[int, int]] = []
    if all(len(x) for x in lists):
        for first, last in sorted(covers(lists), key=lambda c: (c[1] - c[0], c[0])):
            a, b = fragment(first, last, len(chunks))
            if all(b < x or a > y for x, y in chosen):
                chosen.append((a, b))
            if len(chosen) == FRAGMENTS:
                break
    shown = []
    for a, b in sorted(chosen) or [(1, min(LEAST_WORDS, len(chunks)))]:
        good = [i for i in range(a, b + 1) if len(chunks[i - 1][0]) > SHORT_WORD or chunks[i - 1][0].lower() in terms]
        if good and good[-1] - good[0] + 1 >= LEAST_WORDS:
            a, b = good[0], good[-1]
        parts = [(MARKS[0] + w + MARKS[1] if w.lower() in terms else w) + (gap if i < b else "") for i, (w, gap) in enumerate(chunks[a - 1 : b], a)]
        shown.append("".join(parts))
    return BETWEEN.join(shown)


def headlines(found: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """doc_id, headline of matches; docs (doc_id, title, body). Only the matches' texts are shown, so pass those of a page."""
    terms = frozenset(query_words(query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                shown = []
                for body, n_title, row in zip(part.column("body"), part.column("n_title").to_pylist(), part.column("found"), strict=True):
                    lists = [np.array(w["positions"][w["in_title"] :], np.int64) - n_title for w in row.as_py()]
                    shown.append(headline_of(body.as_py(), lists, terms))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shown, pa.string())], ["doc_id", "headline"])

    texts = docs.select("doc_id", F.size(words(F.col("title"))).alias("n_title"), F.coalesce("body", F.lit("")).alias("body"))
    return found.join(texts, "doc_id").select("doc_id", "n_title", "body", "found").mapInArrow(run, "doc_id long, headline string")
