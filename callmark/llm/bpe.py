"""Byte-level BPE over whole texts, long texts in overlapping chunks (operator 8).

A rank file maps byte strings to ids; a pattern splits text into pre-tokens; each pre-token is merged on its own,
lowest rank first, leftmost on ties. Short texts are encoded in the task that reads them. A text longer than
``chunk_chars`` is cut into overlapping chunks that different tasks pre-tokenise. The scanner behind the pattern
keeps no state but its position, so from the first boundary that two neighbours share inside their overlap on, both
see the same pre-tokens: there the chunks are stitched, and the pieces between stitches are encoded in parallel.
Chunks whose overlap shares no boundary (within one endless run of letters, say) are one piece with their neighbours.

Defined results: a null text counts as the empty text; an empty text has no ids and decodes to no bytes; repeated
rows and rows without doc_id each get their own result row; an empty table gives no rows; other columns, whatever their
names, are ignored. A long text that many rows have is encoded once, and its ids are sent to as many tasks as its rows ask for.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import HOT_ROWS, MOST_HOT, few, materialise, name, slices, table, whole

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: A match is certain only if it ends this many characters before the end of its chunk: the pattern looks ahead by two.
LOOK_AHEAD = 3
#: Pre-tokens remembered by a Python worker, and the longest that is remembered.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str, ahead: int = 0) -> bytes:
        """Ids of the text without its last ``ahead`` characters, which only let the scanner look ahead and start at a boundary."""
        found = self.pattern.findall(text)
        while ahead > 0:
            ahead -= len(found.pop())
        return b"".join(map(self.__getitem__, found))

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens that no text after the chunk could change."""
        last = len(text) - LOOK_AHEAD
        return [m.end() for m in self.pattern.finditer(text) if m.end() <= last]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token; a heap of candidate pairs over a linked list, so long pieces cost n log n."""
    if (whole_rank := ranks.get(piece)) is not None:
        return [whole_rank]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(vocabulary: Broadcast, pattern: str) -> Encoder:
    """One per Python worker."""
    key = (hash(vocabulary.value), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary.value, pattern)
    return _ENCODERS[key]


def load_ranks(spark: SparkSession, rank_path: str) -> Broadcast:
    """The rank file, at most some megabytes by its nature, for all executors."""
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encode_column(df: DataFrame, vocabulary: Broadcast, pattern: str, key: str) -> DataFrame:
    """key (any columns) and ids for each row's text."""
    names = [x.strip().split(" ")[0] for x in key.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for part in slices(batches):
            ids = pa.array([encoder.encode(x.as_py(), n.as_py()) for x, n in zip(part.column("text"), part.column("ahead"), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), ids], [*names, "ids"])

    return df.select(*names, "text", "ahead").mapInArrow(run, f"{key}, ids binary")


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, columns to carry along (as long), ids (binary: little-endian unsigned 32-bit integers), a row for each row of docs."""
    own = ["doc_id", *carry]
    docs = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), *(F.col(name(c)).cast("long").alias(c) for c in carry), whole(name(text_col)).alias("text"))
    is_long = F.char_length("text") > chunk_chars
    short = _encode_column(docs.filter(~is_long).withColumn("ahead", F.lit(0)), vocabulary, pattern, ", ".join(f"{c} long" for c in own))
    long = docs.filter(is_long).withColumn("text_key", F.sha2("text", 256))
    by_text = _encode_long(long.select("text_key", "text"), vocabulary, pattern, chunk_chars, overlap_chars)
    rows = long.select(*own, "text_key")
    salts = materialise(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select("text_key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts")))
    if salts.isEmpty() or not few(salts, MOST_HOT):
        return short.unionByName(rows.join(by_text, "text_key").select(*own, "ids"))
    salts = F.broadcast(salts)
    salted = rows.join(salts, "text_key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)).cast("int")).drop("salts")
    spread = by_text.join(salts, "text_key", "left").select("text_key", "ids", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return short.unionByName(salted.join(spread, ["text_key", "salt"]).select(*own, "ids"))


def _encode_long(texts: DataFrame, vocabulary: Broadcast, pattern: str, size: int, overlap: int) -> DataFrame:
    """text_key, ids for each different text."""
    step = size - overlap
    n_chunks = F.greatest(F.lit(1), F.ceil((F.char_length("text") - overlap) / step)).cast("int")
    chunks = (
        texts.select("text_key", "text", n_chunks.alias("n"))
        .select("text_key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("text", i * step + 1, F.lit(size)))).alias("i", "chunk"), "n")
        .groupBy("text_key", "i").agg(F.first("chunk").alias("chunk"), F.first("n").alias("n"))  # deals the chunks out, copies of a text once
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for part in slices(batches, 16):
            heads, tails = [], []
            for i, n, chunk in zip(part.column("i").to_pylist(), part.column("n").to_pylist(), part.column("chunk").to_pylist(), strict=True):
                at = i * step
                ends = encoder.boundaries(chunk)
                heads.append([at + e for e in ends if e < overlap] if i else [])
                tails.append([at + e for e in ends if e >= step] if i < n - 1 else [])
            yield pa.RecordBatch.from_arrays([part.column("text_key"), part.column("i"), part.column("n"), part.column("chunk"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["text_key", "i", "n", "chunk", "head", "tail"])

    scanned = chunks.mapInArrow(scan, "text_key string, i int, n int, chunk string, head array<long>, tail array<long>")
    by_place = Window.partitionBy("text_key").orderBy("i")
    seam = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_place))))
    last = F.col("i") == F.col("n") - 1
    placed = scanned.withColumn("start", seam).withColumn("next", F.lead("start").over(by_place))
    placed = placed.withColumn("piece_no", F.count("start").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a chunk's part begins at its seam, or at its own start if it has none, and ends at the next one's, or where that begins
    first = F.coalesce(F.col("start") - F.col("i") * step, F.lit(0))
    end = F.when(last, F.char_length("chunk")).when(F.col("next").isNotNull(), F.col("next") - F.col("i") * step + LOOK_AHEAD).otherwise(F.lit(step))
    parts = placed.select("text_key", "i", "piece_no", F.substring("chunk", (first + 1).cast("int"), (end - first).cast("int")).alias("part"), F.when(~last & F.col("next").isNotNull(), LOOK_AHEAD).otherwise(0).alias("ahead"))
    joined = lambda of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", of))), lambda x: x[of].cast("string")), "")  # noqa: E731  # bytes or text, in one go
    pieces = parts.groupBy("text_key", "piece_no").agg(joined("part").alias("text"), F.max("ahead").alias("ahead")).withColumnRenamed("piece_no", "i")
    encoded = _encode_column(pieces.withColumn("i", F.col("i").cast("int")), vocabulary, pattern, "text_key string, i int")
    return encoded.groupBy("text_key").agg(joined("ids").cast("binary").alias("ids"))


def decode(encoded: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded (binary: the raw bytes of the ids, one after another). An id outside the vocabulary is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _encoder(vocabulary, "").ranks
        names = [b""] * (max(ranks.values(), default=-1) + 1)
        for name, i in ranks.items():
            names[i] = name
        for part in slices(batches):
            texts = [b"".join(map(names.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col(name(id_col)).alias("doc_id"), F.col(name(ids_col)).alias("ids")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, vocabulary: Broadcast, pattern: str) -> DataFrame:
    both = decode(encode(docs, vocabulary, pattern), vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
