"""Two-pass external shuffle into shards (operator 4).

Pass one scatters the records uniformly into buckets that fit a task's memory, by a seeded hash. Pass two reads one bucket
at a time, shuffles it by Fisher-Yates with a generator seeded for that bucket, and writes it. The buckets' sizes, counted
before the passes, give each bucket its place in the whole order, and the order is cut into shards of equal numbers of rows:
a bucket lies in one shard or in two neighbouring ones, so writing needs no third pass.

The number of buckets follows from the bytes alone and has no upper limit; a task takes one bucket after another. Where a
bucket begins in the order goes with its records, as a row of its own, so the driver holds no table of buckets.

Law ``rows``: the numbers of rows of any two shards differ by at most one. Reruns give the same order, on any number of cores:
the scatter depends on record and seed only, and a bucket is sorted by hash and record before it is shuffled.

Defined results: null ids and texts scatter by the rest of the record; repeated rows are shuffled as records of their own,
and those that repeat more than HOT_COPIES times are counted first and scattered copy by copy, so that no bucket fills with
them; a long text is a record like others, and a bucket holds at least one; fewer rows than shards leave some shards empty;
an empty table gives no rows. The record travels whole, in a struct, so extra columns of any name are kept. Columns of map
type cannot be hashed: name others as key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import few, materialise, name, record, table, whole, work_dir

N_SHARDS = 16
BUCKET_BYTES = 32 << 20
#: Tasks of the second pass; with more buckets each takes several neighbouring ones, one at a time.
MOST_TASKS = 50_000
#: Buckets whose sizes are added up together; their sums reach the driver, a row for so many buckets.
BUCKETS_PER_SUM = 4_096
#: Records that repeat more often are scattered copy by copy; so many different ones are looked up by broadcast.
HOT_COPIES, MOST_HOT = 1_000, 1_000_000
COPIES_PER_ROW = 1_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): from the last place down, each is swapped with a random one not above it."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else [], strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _scattered(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """record and hash of each row of df; of records that repeat often each copy has a hash of its own."""
    columns = [F.col(name(c)) for c in key]
    one = F.xxhash64(F.lit(seed), *columns)
    hot = materialise(df.groupBy(one.alias("hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_COPIES).select("hot"))
    rows = record(df, hash=one)
    if hot.isEmpty():
        return rows
    hot = F.broadcast(hot) if few(hot, MOST_HOT) else hot
    many = rows.join(hot, F.col("hash") == F.col("hot"), "left_semi").groupBy("record", "hash").agg(F.count(F.lit(1)).alias("n"))
    blocks = many.select("record", "hash", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_PER_ROW))).alias("block")).repartition("hash", "block")
    first = F.col("block") * COPIES_PER_ROW
    copies = blocks.select("record", F.col("hash").alias("of"), F.explode(F.sequence(first, F.least(first + COPIES_PER_ROW, F.col("n")) - 1)).alias("copy"))
    return rows.join(hot, F.col("hash") == F.col("hot"), "left_anti").unionByName(copies.select("record", F.xxhash64("of", "copy").alias("hash")))


def shuffle(df: DataFrame, size: Column, key: list[str] | None = None, n_shards: int = N_SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """record (the row of df), shard (int), slot (long, from 0 in each shard). key: the columns that scatter, all by default."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    n_buckets = max(1, -(-total // bucket_bytes))
    rows = _scattered(df, key or df.columns, seed).withColumn("bucket", F.pmod("hash", F.lit(n_buckets)))
    counts = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("sum", F.floor(F.col("bucket") / BUCKETS_PER_SUM)))
    sums = sorted(counts.groupBy("sum").agg(F.sum("n")).collect())  # a row for BUCKETS_PER_SUM buckets
    ahead = np.cumsum([0, *(n for _, n in sums)])
    ends = np.array([int(ahead[-1]) * (k + 1) // n_shards for k in range(n_shards)])  # of the shards in the whole order
    before = F.element_at(F.create_map(*(F.lit(x) for (s, _), a in zip(sums, ahead, strict=False) for x in (s, int(a)))), F.col("sum")) if sums else F.lit(0)
    within = F.sum("n").over(Window.partitionBy("sum").orderBy("bucket")) - F.col("n")
    starts = counts.select(F.lit(None).cast(rows.schema["record"].dataType).alias("record"), F.lit(None).cast("long").alias("hash"), "bucket", (before + within).cast("long").alias("start"))

    per_task = -(-n_buckets // MOST_TASKS)  # neighbours, so that a task's rows, and its file, follow one another
    both = rows.withColumn("start", F.lit(None).cast("long")).unionByName(starts)
    ordered = ["record"] if key is None else [f"record.{name(c)}" for c in key]
    dealt = both.repartitionById(-(-n_buckets // per_task), F.floor(F.col("bucket") / per_task).cast("int")).sortWithinPartitions("bucket", F.col("start").asc_nulls_last(), "hash", *ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            turns = np.flatnonzero(np.diff(own)) + 1
            for first, last in zip([0, *turns], [*turns, len(own)], strict=True):
                if held and held[0].column("bucket")[0].as_py() != own[first]:
                    yield from _place(held, seed, ends)
                    held = []
                held.append(batch.slice(first, last - first))
        if held:
            yield from _place(held, seed, ends)

    schema = rows.select("record", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    return dealt.mapInArrow(run, schema)


def _place(held: list[pa.RecordBatch], seed: int, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One bucket's records in their new order, with their shards and slots; its first row tells where it begins."""
    number, start = (held[0].column(c)[0].as_py() for c in ("bucket", "start"))
    bucket = pa.Table.from_batches(held).column("record").slice(1)
    order = fisher_yates(len(bucket), np.random.default_rng([seed, number]))
    place = start + np.arange(len(order))
    shard = np.searchsorted(ends, place, side="right")
    slot = place - np.where(shard > 0, ends[np.maximum(shard, 1) - 1], 0)
    shuffled = bucket.combine_chunks()
    for at in range(0, len(order), 256):
        part = slice(at, at + 256)
        taken = shuffled.take(pa.array(order[part]))
        taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
        yield pa.RecordBatch.from_arrays([taken, pa.array(shard[part].astype(np.int32)), pa.array(slot[part])], ["record", "shard", "slot"])


def write(shuffled: DataFrame, path: str) -> None:
    """Parquet below path, a folder for each shard; within a shard, files and rows follow the slots."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents into 16 shards, reads them back, and describes what each shard's slots hold."""
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark)
    shuffled = shuffle(docs, (F.octet_length(whole("text")) + 1).cast("long"))
    write(shuffled, path)
    text = whole("record.text")
    return spark.read.schema(shuffled.schema).parquet(path).select(
        "record.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
