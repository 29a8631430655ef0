"""Mean-pooled vectors and cosine links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.operators.shards import deal, matrix
from callmark.session import materialise

SHARD_ROWS = 4_096
#: Sampled items for each centroid, and centroids whose shards an item asks before all others.
TRAIN_ROWS, NEXT_WAVE = 16, 4
#: Components that are averaged side by side.
POOL_WIDTH = 64


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """group, vector: the mean, component by component, of the group's vectors. A vector is a row for each POOL_WIDTH components,
    and their means are that many plain averages, so sums are combined before the shuffle and no group is gathered."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / POOL_WIDTH)), lambda i: F.slice(vector, i.cast("int") * POOL_WIDTH + 1, F.lit(POOL_WIDTH)))
    each = vectors.filter(F.size(vector) > 0).select(group, F.posexplode(parts).alias("part", "x"))
    means = each.groupBy(group, "part").agg(F.max(F.size("x")).alias("n"), *(F.avg(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(POOL_WIDTH)))
    pooled = means.select(group, "part", F.slice(F.array(*(f"x{i}" for i in range(POOL_WIDTH))), F.lit(1), F.col("n")).alias("x"))
    return pooled.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "x"))), lambda p: p["x"])).alias("vector"))


def cosine_links(items: DataFrame, k: int = 10, id_col: str = "item", vector_col: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b, similarity: for each item its k most similar others (rounded to 6 places, ties to the smaller id).

    Items are dealt into shards by nearness to centroids trained on a bounded sample; each asks its own shard first, then those of the
    centroids of best bound, and then only those that can hold something nearer than the k-th found so far. A task holds one shard, and
    answers with k rows at most for each item, so no pair is written out. The result is exact, whatever the centroids.
    """
    vector = F.col(vector_col).cast("array<double>")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = items.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    unit = materialise(rows.withColumn("v", F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-300)))))
    dealt, shards = deal(unit, shard_rows, train=TRAIN_ROWS, unit=True)
    dealt = materialise(dealt)
    width = shards.pivots.shape[1]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                numbers = part.column("shard").to_numpy()
                for one in np.unique(numbers):
                    own = part.filter(pa.array(numbers == one))
                    if one != shard:
                        shard, ids, parts = one, [], []
                    asks = own.column("asks").to_numpy(zero_copy_only=False)
                    vectors, name = matrix(own.column("v"), width), own.column("id").to_numpy()
                    if (~asks).any():
                        ids.append(name[~asks])
                        parts.append(vectors[~asks])
                    if asks.any() and ids:
                        members, there = np.concatenate(ids), np.concatenate(parts)
                        ids, parts = [members], [there]
                        near = np.round(vectors[asks] @ there.T, 6)
                        near[name[asks][:, None] == members[None]] = -2
                        best = np.lexsort((np.broadcast_to(members, near.shape), -near))[:, :k]
                        a, b = np.repeat(name[asks], best.shape[1]), members[best].ravel()
                        value = np.take_along_axis(near, best, 1).ravel()
                        good = value >= -1.5
                        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(value[good])], ["a", "b", "similarity"])

    def search(asking: DataFrame) -> DataFrame:
        both = dealt.select("shard", F.lit(False).alias("asks"), "id", "v").unionByName(asking.select("shard", F.lit(True).alias("asks"), "id", "v"))
        return both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(answer, "a long, b long, similarity double")

    def visits(asking: DataFrame, first: int, last: int | None) -> DataFrame:
        """asking at the shards of the centroids from first to last in order of their bounds, where these reach the least that counts."""

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    row, shard = shards.away(matrix(part.column("v"), width), part.column("least").to_numpy() - 1e-6, part.column("home").to_numpy(), first, last)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(shard.astype(np.int32))], ["id", "v", "shard"])

        return asking.mapInArrow(others, "id long, v array<double>, shard int")

    found = search(dealt)
    waves = [(0, NEXT_WAVE), (NEXT_WAVE, None)] if len(shards.pivots) > 2 * NEXT_WAVE else [(0, None)]
    for first, last in waves if shards.number > 1 else []:
        found = materialise(found)
        kth = found.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("s")).select("id", F.get("s", F.lit(k - 1)).alias("least"))  # k rows a wave and shard
        asking = dealt.withColumnRenamed("shard", "home").join(kth, "id", "left").select("id", "v", "home", F.coalesce("least", F.lit(-2.0)).alias("least"))
        found = found.unionByName(search(visits(asking, first, last)))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return found.withColumn("rn", best).filter(F.col("rn") <= k).drop("rn")
