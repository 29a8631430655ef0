"""Exact top-k inner-product search: ball trees per shard, branch and bound (operator 2).

Vectors are quantised to floor(scale * x) and dealt into shards by nearness (``operators.shards``); a task builds a ball tree
over its shard and streams the queries past it. For a query q and a ball of centre c and radius r no member's inner product
exceeds q.c + |q| r; nodes are opened in order of this bound, until it falls under the current k-th score. The k-th score is
shared in waves: a query first searches the shard that its own vector is in; with the score found there it goes to the
shards of highest bound, and with the best of both to all others. A shard whose own ball cannot reach the score is never
visited: pairs of a query and a shard are formed only where the bound allows.

What this saves depends on the data: of vectors in clusters most shards and nodes are passed over, while random directions
of one length (as in the synthetic tables) leave every bound over every score, and all is compared.

The query set is stated by the caller; a shard answers with at most k rows for a query. Queries are dealt into blocks, and a task
answers one block's at one shard.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
rows that repeat an id are candidates each for itself, and each a query if the id is one (a row is no candidate of its own, but
the others of its id are); ties go to the smaller id; of vectors of different lengths the shorter counts as padded with zeros; scores beyond 64 bits are put at the nearest that fits;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import materialise, name, slices, table
from callmark.operators.shards import Shards, deal, matrix

SHARD_ROWS = 8_192
LEAF = 256
#: Queries of a block; more than so many ask each shard in several tasks.
QUERY_BLOCK = 65_536
#: Pivots whose shards a query visits, by bound, before all others.
SECOND_WAVE = 4
EXACT = 2.0**53


class BallTree:
    """nodes: (centre, radius, first, last, left, right); left < 0 marks a leaf. Rows are kept in leaf order; they are told apart by
    number and ordered by id."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []
        self._split(vectors, order, 0, len(order))
        self.numbers, self.ids, self.vectors = numbers[order], ids[order], vectors[order]
        self.centres = np.stack([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        self.largest = float(np.abs(vectors).max(initial=0))
        self.compared = 0  # members that queries were compared with

    def _split(self, vectors: np.ndarray, order: np.ndarray, first: int, last: int) -> int:
        own = vectors[order[first:last]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        number = len(self.nodes)
        self.nodes.append((centre, float(away.max(initial=0)), first, last, -1, -1))
        if last - first > LEAF:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own @ (other - one), half)]
            left = self._split(vectors, order, first, first + half)
            right = self._split(vectors, order, first + half, last)
            self.nodes[number] = (*self.nodes[number][:4], left, right)
        return number

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """query x node: over any member's inner product, rounding included."""
        lengths = np.sqrt((queries**2).sum(1))
        top = queries @ self.centres.T + lengths[:, None] * self.radii
        return top + 1e-9 * (np.abs(top) + lengths[:, None] * (np.sqrt((self.centres**2).sum(1)) + self.radii)) + 1e-6

    def search(self, number: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best members at or over least, but for the query's own row."""
        ids, scores = np.empty(0, np.int64), np.empty(0)
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT
        open_ = [(-bounds[0], 0)]
        while open_ and -open_[0][0] >= least:
            _, n = heapq.heappop(open_)
            _, _, first, last, left, right = self.nodes[n]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= least:
                        heapq.heappush(open_, (-bounds[child], child))
                continue
            self.compared += last - first
            own = self.vectors[first:last] @ query if exact else _big(self.vectors[first:last], query)
            good = (own >= least) & (self.numbers[first:last] != number)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[first:last][good]]), np.concatenate([scores.astype(own.dtype), own[good]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, float(scores[-1]))
        return ids, scores


def _big(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products that doubles cannot hold, as integers put within 64 bits."""
    q = [int(x) for x in query]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * y for x, y in zip(v, q, strict=True)))) for v in vectors], object)


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id (a number for each row), name (its vec_id), v (array of whole doubles) of the rows with a sound vector."""
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = df.select(F.col(name(id_col)).cast("long").alias("name"), F.col(name(vector_col)).cast("array<double>").alias("vector")).filter(F.col("name").isNotNull() & sound)
    return rows.select(F.monotonically_increasing_id().alias("id"), "name", F.transform("vector", lambda x: _floor(x * F.lit(float(scale)))).alias("v"))


def _floor(x: Column) -> Column:
    """floor() as a double; from 2^52 on doubles are whole."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _search(candidates: DataFrame, queries: DataFrame, k: int, width: int, blocks: int) -> DataFrame:
    """candidates: shard, id, name, v; queries: shard, id, name, v, least. query, query_id, vec_id, score (query: the query's row)."""
    none = F.lit(None).cast("double")
    own = candidates.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "name", "v", none.alias("least"))
    rows = own.unionByName(queries.select("shard", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "name", "v", "least"))
    dealt = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, held = None, None, []
        for batch in slices(batches, 512):
            place, asks = (batch.column("shard").to_numpy().astype(np.int64) << 32) + batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            numbers, names, vectors = batch.column("id").to_numpy(), batch.column("name").to_numpy(), matrix(batch.column("v"), width)
            least = np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False), nan=-np.inf)
            turns = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for first, last in zip([0, *turns], [*turns, len(place)], strict=True):
                part = slice(first, last)
                if place[first] != at:
                    at, tree, held = place[first], None, []
                if not asks[first]:
                    held.append((numbers[part], names[part], vectors[part]))
                    continue
                if tree is None and held:
                    tree = BallTree(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                if tree is not None:
                    yield _answers(tree, numbers[part], names[part], vectors[part], least[part], k)

    return dealt.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _answers(tree: BallTree, numbers: np.ndarray, names: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pa.RecordBatch:
    bounds = tree.bounds(queries)
    found = [tree.search(i, q, b, k, m) for i, q, b, m in zip(numbers, queries, bounds, least, strict=True)]
    many = [len(f[0]) for f in found]
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(numbers, many)), pa.array(np.repeat(names, many)),
        pa.array(np.concatenate([f[0] for f in found])),
        pa.array([int(x) for f in found for x in f[1]], pa.int64()),
    ], ["query", "query_id", "vec_id", "score"])


def _visits(queries: DataFrame, shards: Shards, first: int, last: int | None) -> DataFrame:
    """shard, id, name, v, least: queries (home, id, name, v, least) at the shards of the pivots from first to last in order of their bounds, where these reach least."""
    width = shards.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            least = part.column("least")
            row, shard = shards.away(matrix(part.column("v"), width), np.nan_to_num(least.to_numpy(zero_copy_only=False), nan=-np.inf), part.column("home").to_numpy(), first, last)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("id", "name", "v", "least"))], ["shard", "id", "name", "v", "least"])

    return queries.mapInArrow(run, "shard int, id long, name long, v array<double>, least double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products with the other rows. is_query sees name (the vec_id) and v (quantised)."""
    dealt, shards = deal(materialise(quantised(vectors, id_col, vector_col, scale)), shard_rows, carry=("name",))
    dealt = materialise(dealt)
    width = shards.pivots.shape[1]
    queries = dealt.filter(is_query).withColumn("least", F.lit(None).cast("double"))
    blocks = max(1, -(-queries.count() // query_block))
    found = _search(dealt, queries, k, width, blocks)
    waves = [(0, SECOND_WAVE), (SECOND_WAVE, None)] if len(shards.pivots) > 2 * SECOND_WAVE else [(0, None)]
    for first, last in waves if shards.number > 1 else []:
        found = materialise(found)
        kth = found.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query", F.get("s", F.lit(k - 1)).cast("double").alias("kth"))  # at most k rows a wave and shard
        asking = queries.withColumnRenamed("shard", "home").join(kth, F.col("id") == F.col("query"), "left").select("home", "id", "name", "v", F.col("kth").alias("least"))
        found = found.unionByName(_search(dealt, _visits(asking, shards, first, last), k, width, blocks))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("name") % 20 == 0)


ORACLE = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
), scored AS (
    SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.r <> b.r
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
