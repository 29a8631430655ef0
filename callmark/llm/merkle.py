"""Merkle-tree fingerprints of documents (operator 3).

A text's tree has four levels: leaves are sentences; paragraphs are lines; sections are runs of lines between blank lines or
headings; the root stands for the text. A node's hash covers its children's hashes and number, a leaf's covers its characters,
a line's end with the last one of the line, so two roots are equal exactly if the texts are.

Two trees are compared from the root down. The children of a node are aligned with the other's by their hashes, in order;
aligned ones are equal and not entered, and the children of what stands between them, on both sides, are aligned in turn.
What is left between aligned paragraphs are the edits: places where paragraphs of one text were changed, left out or put in.
What is left between aligned leaves is compared by words, each told by itself and the one after it; where words are very long, as in
scripts without spaces, runs of characters, cut by content, are words. Words are made where texts differ only, by the same rule at all lengths.
Likeness is the share of characters in leaves and words that were aligned, so moved text counts as different where it moved.

Defined results: a null text counts as the empty text, whose root is that of no section; two empty texts have likeness 1;
a long text's tree is held by the task that reads it, with its neighbour's; documents follow one another by (doc_id, hash of
the text, text), null ids first, so repeated rows are each other's neighbours; the first follows the last; a table of one row
is its own neighbour, an empty one gives no rows; other columns, whatever their names, are ignored. An id that many rows
have (or none: null) is dealt to several tasks by the texts' hashes; only rows that repeat id and text meet in one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import name, slices, table, whole

SENTENCE = re.compile(r"[^.!?。！？]*[.!?。！？]+[\s\"')\]」』”]*|[^.!?。！？]+")
#: A word of more characters is cut where two neighbours say so, one place of CHARS_EVERY.
LONG_WORD, CHARS_EVERY = 16, 4
HEADING = re.compile(r"#{1,6} |[=-]{3,}$")
DIGEST = 16
#: Documents that one task streams through, about; the number of tasks grows with the table.
ROWS_PER_RANGE, MOST_RANGES = 4_000, 20_000
#: Stands for a null id, and for the least hash.
NO_ID = -(2**63)


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


@dataclass
class Tree:
    """The text ends with its last line's end. Sections and paragraphs: (hash, first child, end); of leaves their hashes, and where they begin in the text."""

    text: str
    root: bytes
    sections: list[tuple[bytes, int, int]]
    paragraphs: list[tuple[bytes, int, int]]
    leaves: list[bytes]
    starts: list[int]  # one more entry than leaves

    def __post_init__(self) -> None:
        self._words: dict[tuple[int, int], tuple[list[int], list[int]]] = {}

    @property
    def chars(self) -> int:
        return self.starts[-1]

    def size(self, first: int, end: int) -> int:
        """Characters in leaves from first to end."""
        return self.starts[end] - self.starts[first]

    def words(self, first: int, end: int) -> tuple[list[int], list[int]]:
        """Hashes and characters of the words of leaves from first to end."""
        key = (self.starts[first], self.starts[end])
        if key not in self._words:
            if len(self._words) > 8:
                self._words.clear()
            self._words[key] = words(self.text[key[0] : key[1]])
        return self._words[key]


def cut(paragraph: str) -> list[str]:
    """The paragraph's leaves; joined they are the paragraph."""
    return SENTENCE.findall(paragraph)


_SPACE = np.zeros(0x3002, bool)
_SPACE[[*range(33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(4_096, 2 * n)
        for way, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[way] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def words(text: str) -> tuple[list[int], list[int]]:
    """Hashes (64 bits, of a word and the next) and characters of the text's words with the white space after them; all at once, by prefix sums."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(code)
    if not n:
        return [], []
    space = _SPACE[np.minimum(code, len(_SPACE) - 1)]
    code = code.astype(np.uint64)
    begins = np.empty(n, bool)
    begins[0] = True
    np.greater(space[:-1], space[1:], out=begins[1:])
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=n)
    if sizes.max() > LONG_WORD:
        pair = _mixed(code[:-1] * np.uint64(_BASE) + code[1:])
        begins[1:] |= np.repeat(sizes > LONG_WORD, sizes)[1:] & (pair % np.uint64(CHARS_EVERY) == 0)
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=n)
    up, down = _powers(n)
    each = np.add.reduceat((code + np.uint64(1)) * up, starts) * down[starts]
    return (_mixed(_mixed(each) + np.append(each[1:], np.uint64(0)))).tolist(), sizes.tolist()


def build(text: str) -> Tree:
    lines = text.split("\n") if text else []
    sections: list[tuple[bytes, int, int]] = []
    paragraphs: list[tuple[bytes, int, int]] = []
    leaves: list[bytes] = []
    starts, at, first = [0], 0, 0

    def close(end: int) -> None:
        if end > first:
            sections.append((_hash(b"s" + b"".join(p[0] for p in paragraphs[first:end])), first, end))

    for line in lines:
        if (not line.strip() or HEADING.match(line)) and len(paragraphs) > first:
            close(len(paragraphs))
            first = len(paragraphs)
        own = cut(line) or [""]
        own[-1] += "\n"
        begin = len(leaves)
        for leaf in own:
            leaves.append(_hash(leaf.encode()))
            at += len(leaf)
            starts.append(at)
        paragraphs.append((_hash(b"p" + b"".join(leaves[begin:])), begin, len(leaves)))
    close(len(paragraphs))
    return Tree(text + "\n" if text else "", _hash(b"r" + b"".join(s[0] for s in sections)), sections, paragraphs, leaves, starts)


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """(i, j) with a[i] == b[j], both rising: equal ends first, then a longest rising sequence of pairs of equal rank among their equals."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    seen: dict[object, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        seen.setdefault(b[j], []).append(j)
    pairs = [(i, places.pop()) for i in range(head, len(a) - tail) if (places := seen.get(a[i]))]
    least: list[int] = []  # of the rising sequences of each length, the least last place
    at: list[int] = []
    before = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(least, j)
        before[p] = at[k - 1] if k else -1
        least[k : k + 1], at[k : k + 1] = [j], [p]
    middle, p = [], at[-1] if at else -1
    while p >= 0:
        middle.append(pairs[p])
        p = before[p]
    ends = [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    return [(i, i) for i in range(head)] + middle[::-1] + ends


def gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """(a's first, last, b's first, last), ends excluded, of what stands between aligned places of sequences of n and m."""
    i = j = 0
    for x, y in [*pairs, (n, m)]:
        if x > i or y > j:
            yield i, x, j, y
        i, j = x + 1, y + 1


@dataclass
class Comparison:
    shared: int  # characters in aligned leaves and words
    edits: list[tuple[int, int, int, int]]  # paragraphs of a, of b (first and end of each)


def compare(a: Tree, b: Tree) -> Comparison:
    """From the root down; nodes that are aligned are not entered."""
    if a.root == b.root:
        return Comparison(a.chars, [])
    out = Comparison(0, [])
    first_of = lambda nodes, i, end: nodes[i][1] if i < len(nodes) else end
    sections = aligned([x[0] for x in a.sections], [x[0] for x in b.sections])
    for i, _ in sections:
        _, first, end = a.sections[i]
        out.shared += a.size(a.paragraphs[first][1], a.paragraphs[end - 1][2])
    for i, x, j, y in gaps(sections, len(a.sections), len(b.sections)):
        p0, p1 = (first_of(a.sections, k, len(a.paragraphs)) for k in (i, x))
        q0, q1 = (first_of(b.sections, k, len(b.paragraphs)) for k in (j, y))
        lines = aligned([p[0] for p in a.paragraphs[p0:p1]], [p[0] for p in b.paragraphs[q0:q1]])
        out.shared += sum(a.size(*a.paragraphs[p0 + k][1:]) for k, _ in lines)
        for p, q, r, s in gaps(lines, p1 - p0, q1 - q0):
            out.edits.append((p0 + p, p0 + q, q0 + r, q0 + s))
            l0, l1 = (first_of(a.paragraphs, k, len(a.leaves)) for k in (p0 + p, p0 + q))
            m0, m1 = (first_of(b.paragraphs, k, len(b.leaves)) for k in (q0 + r, q0 + s))
            leaves = aligned(a.leaves[l0:l1], b.leaves[m0:m1])
            out.shared += sum(a.size(l0 + k, l0 + k + 1) for k, _ in leaves)
            for t, u, v, w in gaps(leaves, l1 - l0, m1 - m0):
                if t < u and v < w:
                    out.shared += shared_words(a.words(l0 + t, l0 + u), b.words(m0 + v, m0 + w))
    return out


def shared_words(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> int:
    """Characters of aligned words; those that the other side lacks are left out first."""
    both = set(a[0]).intersection(b[0])
    if not both:
        return 0
    ours = [i for i, h in enumerate(a[0]) if h in both]
    found = aligned([a[0][i] for i in ours], [h for h in b[0] if h in both])
    return sum(a[1][ours[i]] for i, _ in found)


def likeness(a: Tree, b: Tree, shared: int | None = None) -> float:
    """Characters in aligned leaves and words over all characters, of both texts; a line's end counts with its line."""
    if a.root == b.root:
        return 1.0
    return 2 * (compare(a, b).shared if shared is None else shared) / (a.chars + b.chars)


def differing(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """The edits from a to b: first paragraph and end in a, and in b; an empty range on one side is text put in or left out."""
    return compare(a, b).edits


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many first characters of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of (doc_id, hash of the text), one a partition, each with the first row of the next range as ``__tail``.

    Ranges are cut at approximate quantiles of the ids, and ids that fill ranges alone at quantiles of their hashes. Cuts and each
    range's first (id, hash) are all that reaches the driver, and MOST_RANGES bounds their number. Rows without an id come first.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.xxhash64("text").alias("__hash"), F.col("doc_id").isNull().alias("__none"), "text")
    number = rows.count()
    wanted = max(1, min(MOST_RANGES, max(number // ROWS_PER_RANGE, docs.sparkSession.sparkContext.defaultParallelism)))
    quantiles = lambda c: F.percentile_approx(c, [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted)
    ids = Counter(rows.agg(quantiles("__id")).first()[0] or [])
    cuts = {(NO_ID, NO_ID), *((i, NO_ID) for i in ids)}
    hot = [i for i, n in ids.items() if n > 1]
    if hot:
        # quantiles are doubles inside, so those of 53 bits are taken
        for r in rows.filter(F.col("__id").isin(hot)).groupBy("__id").agg(quantiles(F.shiftright("__hash", 11)).alias("q"), F.count(F.lit(1)).alias("n")).collect():
            step = max(1, round(number / r["n"]))  # as many cuts as the id has ranges
            cuts |= {(r["__id"], h << 11) for h in r["q"][step - 1 :: step]}
    cut_ids, cut_hashes = (np.array(x, dtype=np.int64) for x in zip(*sorted(cuts), strict=True))

    @F.pandas_udf("int")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        i, h = ids.to_numpy(), hashes.to_numpy()
        first, end = np.searchsorted(cut_ids, i, side="left"), np.searchsorted(cut_ids, i, side="right")
        at = end - 1
        for k in np.flatnonzero(end - first > 1):
            at[k] = first[k] + np.searchsorted(cut_hashes[first[k] : end[k]], h[k], side="right") - 1
        return pd.Series(at)

    placed = rows.withColumn("__place", place("__id", "__hash"))
    firsts = sorted((r["__place"], *r["first"]) for r in placed.groupBy("__place").agg(F.min(F.struct("__id", "__hash")).alias("first")).collect())
    numbers, first_ids, first_hashes = (np.array(x, dtype=np.int64) for x in (zip(*firsts, strict=True) if firsts else ([0], [0], [0])))

    @F.pandas_udf("array<int>")
    def parts(places: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The number of the row's range, and that of the range before, round the table, if the row is its range's first."""
        at = np.searchsorted(numbers, places.to_numpy())
        begins = (first_ids[at] == ids.to_numpy()) & (first_hashes[at] == hashes.to_numpy())
        return pd.Series([[n, (n - 1) % len(numbers)] if b else [n] for n, b in zip(at.tolist(), begins.tolist(), strict=True)])

    dealt = placed.select("__id", "__hash", F.when(~F.col("__none"), F.col("__id")).alias("doc_id"), "text", F.posexplode(parts("__place", "__id", "__hash")).alias("__tail", "__part")).withColumn("__tail", F.col("__tail") == 1)
    return dealt.repartitionById(len(numbers), F.col("__part")).sortWithinPartitions("__part", "__tail", "__id", "__hash", "text").select("doc_id", "text", "__part", "__tail")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text's length, root, tree sizes, and the same of the edited text, with likenesses; a row for each row of docs.

    Each task streams through one range in order and holds two documents at a time.
    """
    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), whole(name(text_col)).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections int, n_paragraphs int, n_leaves int, n_edits int, edits string, edited_text string"

    def row(doc_id: int | None, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
        new = edited(text, following)
        new_tree = build(new)
        found = compare(tree, new_tree)
        places = ",".join(f"{a}-{b}:{c}-{d}" for a, b, c, d in found.edits)
        return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), tree.root.hex(), new_tree.root.hex(), likeness(tree, new_tree, found.shared), likeness(tree, next_tree),
                len(tree.sections), len(tree.paragraphs), len(tree.leaves), len(found.edits), places, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = part = None
        closed = False
        for batch in slices(batches):
            out = []
            for doc_id, text, number, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__part", "__tail")), strict=True):
                if number != part:
                    held, part, closed = None, number, False
                if tail and closed:
                    continue
                tree = build(text)
                if held:
                    out.append(row(*held, text, tree))
                held, closed = (doc_id, text, tree), tail
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

    return in_ranges(docs).mapInArrow(run, schema)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_sections", "n_paragraphs", "n_leaves", "n_edits", "edits", "edited_text"]
TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int32()] * 4, *[pa.string()] * 2]


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents")).drop("edited_text")
