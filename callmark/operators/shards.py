"""Vectors dealt into shards by nearness, so that a query need not visit shards that cannot hold what it looks for.

Pivots are a bounded sample of the vectors, or centroids trained on one; every vector goes to its nearest pivot, and a pivot with more
vectors than a shard may hold is several shards. No member of a pivot's shards has a larger inner product with q than q.p + |q| r, where r
is the distance of its farthest member from the pivot p. Among vectors of length one it is not over 1 - d^2 / 2 either, where d is
what of q's distance from p is left beyond r, since no member is nearer to q than that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many pivots at most reach the driver and the tasks; more shards than that are parts of pivots' shards.
MOST_PIVOTS = 1_024
#: Rounds in which centroids are trained.
ROUNDS = 8
#: Elements of a distance matrix that a task holds at one time.
BLOCK = 4 << 20


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are padded with zeros, longer ones cut. One view of the values if all have the width."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(vectors) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(vectors), width))
    ends = np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends, lengths, strict=True)):
        out[i, : min(n, width)] = values[end - n : end - n + min(n, width)]
    return out


@dataclass
class Shards:
    pivots: np.ndarray  # pivot x width
    radii: np.ndarray
    first: np.ndarray  # number of a pivot's first shard; one more entry than pivots
    unit: bool = False  # are all vectors of length one?

    @property
    def number(self) -> int:
        return int(self.first[-1])

    def away(self, queries: np.ndarray, least: np.ndarray, home: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query's row, shard) of all shards but home that may hold an inner product of at least least; of the pivots from first to last, by bound."""
        bound = queries @ self.pivots.T + np.sqrt((queries**2).sum(1))[:, None] * self.radii
        if self.unit:
            apart = np.sqrt(np.maximum(0, 1 + (self.pivots**2).sum(1) - 2 * (queries @ self.pivots.T)))
            bound = np.minimum(bound, 1 - np.maximum(0, apart - self.radii) ** 2 / 2)
        bound += 1e-9 * np.abs(bound) + 1e-6
        wanted = bound >= least[:, None]
        if first or last is not None:
            place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
            wanted &= (place >= first) & (place < (len(self.pivots) if last is None else last))
        row, pivot = np.nonzero(wanted)
        sizes = np.diff(self.first)[pivot]
        shard = np.repeat(self.first[pivot] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        row = np.repeat(row, sizes)
        other = shard != home[row]
        return row[other], shard[other]


def trained(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids of the sample: its first k rows, moved to the means of the rows nearest to them, a few times. One that has no rows stays where it is."""
    centres = sample[:k].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((centres**2).sum(1) - 2 * (part @ centres.T)).argmin(1) for part in np.array_split(sample, max(1, len(sample) * k // BLOCK))])
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def deal(rows: DataFrame, shard_rows: int, most_pivots: int = MOST_PIVOTS, carry: Sequence[str] = (), train: int = 1, unit: bool = False) -> tuple[DataFrame, Shards]:
    """(id, columns to carry, v, shard) and the shards. rows: id (long), v (array<double>), none of them null; read four times, so it should be a table.

    train: sampled rows for each pivot; with more than one, pivots are trained on them. unit: all vectors are of length one.
    """
    size, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    wanted = max(1, min(most_pivots, -(-size // shard_rows)))
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(wanted * train).collect()  # at most most_pivots * train
    width = width or 0
    pivots = np.zeros((max(1, len(sample)), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    if train > 1:
        pivots = trained(pivots, wanted)
    lengths = (pivots**2).sum(1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, BLOCK // max(len(pivots), width, 1))):
                part = batch.slice(at, step)
                own = matrix(part.column("v"), width)
                pivot = (lengths - 2 * (own @ pivots.T)).argmin(1)
                away = np.sqrt(((own - pivots[pivot]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(pivot.astype(np.int32)), pa.array(away)], [*names, "pivot", "away"])

    names = ["id", *carry, "v"]
    placed = rows.select(*names).mapInArrow(nearest, rows.select(*names, F.lit(0).alias("pivot"), F.lit(0.0).alias("away")).schema)
    counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():  # at most MOST_PIVOTS rows
        counts[r["pivot"]], radii[r["pivot"]] = r["n"], r["r"]
    parts = np.maximum(1, -(-counts // shard_rows))
    first = np.concatenate([[0], np.cumsum(parts)])
    at = lambda numbers: F.element_at(F.lit([int(x) for x in numbers]), F.col("pivot") + 1)
    shard = (at(first[:-1]) + F.pmod(F.xxhash64("id"), at(parts))).cast("int")
    return placed.select(*names, shard.alias("shard")), Shards(pivots, radii, first, unit)
