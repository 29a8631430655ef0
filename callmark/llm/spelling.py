"""Spelling variants by sorted permuterm rotations (operator 12).

A word w is marked at its end, w$. A rotation of it that ends with the letter at place p is w after p, $, w before p and that letter:
words that differ in this letter only share all of the rotation but its end, and a word that lacks this letter has what they share
as a whole rotation of its own. So every word gives each of its rotations twice: without its last letter (which is skipped), and whole.
All are dealt by ranges and sorted; a group of equal keys holds one word for each skipped letter and at most one whole rotation,
so no group has more members than the alphabet has letters, plus one. One scan gives each member the number of its
neighbours in the group and the best of them; no pairs are written. A letter that repeats the one before counts for replacements only: to leave
out the one or the other gives the same word. Words are known by their place in the order of (most occurrences, code points), so the best
neighbour is the smallest number. Forms are followed to roots by doubling: a form has at least twice the occurrences, so chains are short.

Keys of more than LONG_CHARS letters would fill a square in memory; they are digests of the parts before and after the skipped letter (four
31-bit sums by powers and the place), computed in one pass over the word.

Defined results: a null text has no runs; a row without doc_id counts as one whose id is the empty text; repeated rows count again;
a table without words gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import kept, materialise, name, running, scratch, table, whole

# The query's contract.
RUN = r"[a-zÀ-ÿ]+"
TYPO_PERIOD, LEAST_CHARS, LEAST_COUNT = 97, 5, 3
END = "$"
#: Keys up to so many letters are texts.
LONG_CHARS = 64
#: What a key's row is: a whole rotation, one without its last letter, and one whose last letter does not repeat the one before.
WHOLE, SKIPS, SKIPS_FIRST = 0, 1, 2
NOBODY = np.int64(2**63 - 1)
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 69_069)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (as text), run: a row for each run of letters of the texts, A-Z in lower case."""
    folded = F.translate(whole(name(text_col)), string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.coalesce(F.col(name(id_col)).cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(folded, F.lit(RUN), F.lit(0))).alias("run"))


def with_typos(found: DataFrame, period: int = TYPO_PERIOD) -> DataFrame:
    """word: the run, without one of its letters where the checksum of id and run is divisible by period."""
    made = found.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.char_length("run")).cast("int")
    return made.select(F.when(F.col("h") % period == 0, F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.char_length("run")))).otherwise(F.col("run")).alias("word"))


def vocabulary(found: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of so many letters and occurrences."""
    return found.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame, long_chars: int = LONG_CHARS) -> DataFrame:
    """key, kind, place: the keys of words (word, place), as texts or digests."""
    size = F.char_length("word")
    skipped = lambda i: F.concat(F.substring("word", i + 2, size), F.lit(END), F.substring("word", F.lit(1), i))
    entire = lambda i: F.concat(F.substring("word", i + 1, size), F.lit(END), F.substring("word", F.lit(1), i))
    repeats = lambda i: (i > 0) & (F.substring("word", i, F.lit(1)) == F.substring("word", i + 1, F.lit(1)))
    row = lambda key, kind: F.struct(key.alias("key"), kind.cast("int").alias("kind"))
    none = F.array().cast("array<struct<key: string, kind: int>>")
    skips = F.when(size <= long_chars + 1, F.transform(F.sequence(F.lit(0), size - 1), lambda i: row(skipped(i), F.when(repeats(i), SKIPS).otherwise(SKIPS_FIRST)))).otherwise(none)
    wholes = F.when(size <= long_chars, F.transform(F.sequence(F.lit(0), size), lambda i: row(entire(i), F.lit(WHOLE)))).otherwise(none)
    texts = words.filter((size > 0) & (size <= long_chars + 1)).select("place", F.explode(F.concat(skips, wholes)).alias("x")).select("x.key", "x.kind", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, place in zip(batch.column("word"), batch.column("place").to_pylist(), strict=True):
                for keys, kinds in digests(word.as_py(), long_chars):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(np.full(len(keys), place))], ["key", "kind", "place"])

    return texts.unionByName(words.filter(size > long_chars).select("word", "place").mapInArrow(digest, "key string, kind int, place long"))


def digests(word: str, long_chars: int, rows: int = 1 << 14) -> Iterator[tuple[list[str], np.ndarray]]:
    """Digest keys of a word and their kinds, in portions."""
    code = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(code)
    ahead, behind = [], []  # for each prime: sums over the first i letters, and over the last n - i
    for prime, base in zip(PRIMES, BASES, strict=True):
        power = np.ones(n, np.uint64)
        done = 1
        while done < n:  # powers by doubling
            more = min(done, n - done)
            power[done : done + more] = power[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += more
        total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power % np.uint64(prime)) % np.uint64(prime)])  # noqa: B023, E731
        ahead.append(total(code))
        behind.append(total(code[::-1])[::-1])
    repeats = np.concatenate([[False], code[1:] == code[:-1]])
    for skip in (1, 0):
        if n - skip > long_chars:
            for at in range(0, n + 1 - skip, rows):
                i = np.arange(at, min(at + rows, n + 1 - skip))
                parts = [*(a[i] for a in ahead), *(b[i + skip] for b in behind)]
                kinds = np.where(repeats[np.minimum(i, n - 1)], SKIPS, SKIPS_FIRST) if skip else np.full(len(i), WHOLE)
                yield [f"#{n - skip}:{p}:{a:x}:{b:x}:{c:x}:{d:x}" for p, a, b, c, d in zip(i.tolist(), *(x.tolist() for x in parts), strict=True)], kinds.astype(np.int32)


def neighbours(keys: DataFrame) -> DataFrame:
    """place, n_near, best: of each word with neighbours their number, and the smallest of their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of equal keys stand together; the last group of a batch goes on into the next."""
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks().to_batches()[:1]
            if not rows:
                continue
            key = rows[0].column("key")
            starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1])
            yield near(rows[0].slice(0, starts[-1]), starts[:-1])
            left = rows[0].slice(starts[-1])
        if left is not None:
            yield near(left, np.array([0]))

    def near(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, rows.num_rows))
        shared = np.repeat(sizes > 1, sizes)
        kind, place = rows.column("kind").to_numpy()[shared], rows.column("place").to_numpy()[shared]
        sizes = sizes[sizes > 1]
        count = best = place
        if len(sizes):
            starts = np.cumsum(sizes) - sizes
            spread = lambda x: np.repeat(x, sizes)
            least = lambda which: spread(np.minimum.reduceat(np.where(which, place, NOBODY), starts))
            number = lambda which: spread(np.add.reduceat(which.astype(np.int64), starts))
            skips, first = kind != WHOLE, kind == SKIPS_FIRST
            entire, one = least(kind == WHOLE), least(skips)
            two = least(skips & (place != one))
            other = np.where(place == one, two, one)
            count = np.where(skips, number(skips) - 1 + (first & (entire != NOBODY)), number(first))
            best = np.where(skips, np.minimum(other, np.where(first, entire, NOBODY)), least(first))
        some = count > 0 if len(sizes) else slice(0)
        return pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(count[some]), pa.array(best[some])], ["place", "n_near", "best"])

    found = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(scan, "place long, n_near long, best long")
    return found.groupBy("place").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """place, root: where the forms (place, form) lead in the end. Every round doubles the steps taken."""
    found = materialise(forms.select("place", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("place").alias("root"), F.col("root").alias("next"))
        longer = materialise(found.join(ahead, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = longer.select("place", "root")
        if longer.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, factor: int = 2, long_chars: int = LONG_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words with their counts (word, n)."""
    with scratch(words.sparkSession):
        words = materialise(words.select("word", "n"))  # read more than once below
        numbered = materialise(running(words, [F.desc("n"), F.asc("word")]).select("word", "n", "place"))
        near = neighbours(rotations(numbered, long_chars))
        other = lambda x: numbered.select(F.col("place").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
        near = near.join(other("best"), "best")
        all_of = materialise(numbered.join(near, "place", "left").withColumn("good", F.col("best_n") >= factor * F.col("n")))
        ends = roots(all_of.filter("good").select("place", F.col("best").alias("form"))).join(other("root"), "root").select("place", "root_word")
        good = lambda x: F.when(F.col("good"), F.col(x))
        found = all_of.join(ends, "place", "left").select("word", good("best_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), good("best_n").alias("form_n"))
        return kept(found)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(with_typos(runs(table(spark, sf_dir, "documents")))))


#: The checksum's table is made by its rule; neighbours are found by words with a hole and by words that lack a letter.
ORACLE = f"""WITH RECURSIVE bits AS (SELECT b, 0 AS k, b AS v FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM pairs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substring(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % {TYPO_PERIOD} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(n) >= {LEAST_COUNT}),
cut AS (SELECT DISTINCT word, n, left(word, i) || '_' || substring(word, i + 2) AS hole, left(word, i) || substring(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT c.word, c.n, w.word AS other, w.n AS other_n FROM cut c JOIN words w ON w.word = c.less),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
own AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM own UNION ALL SELECT s.word, o.form FROM steps s JOIN own o ON o.word = s.root WHERE o.form IS NOT NULL)
SELECT word, form, s.root, n, n_near, form_n FROM own JOIN (SELECT s.word, s.root FROM steps s JOIN own o ON o.word = s.root AND o.form IS NULL) s USING (word)"""
