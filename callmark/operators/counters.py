"""Counters that are kept: partial states by key, merged with those of what came in addition, and held against a recount."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmark.session import materialise
from callmark.sources.store import Store

#: How two states of a kind become one.
MERGES: Mapping[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def states(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """keys and the states of measures, name -> (kind, column): sum, count (of rows where the column is true), min or max."""
    first = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "count": lambda c: F.count_if(c), "min": F.min, "max": F.max}
    return rows.groupBy(*keys).agg(*(first[kind](c).alias(n) for n, (kind, c) in measures.items()))


def merged(old: DataFrame, delta: DataFrame, keys: Sequence[str], kinds: Mapping[str, str]) -> DataFrame:
    """States of old and delta as one, a row for each key; combined before the shuffle, so a key never gathers its deltas."""
    both = old.select(*keys, *kinds).unionByName(delta.select(*keys, *kinds))
    total = both.groupBy(*keys).agg(*(MERGES[k](n).alias(n) for n, k in kinds.items()))
    types = dict(old.dtypes)
    return total.select(*keys, *(F.col(n).cast(types[n]).alias(n) for n in kinds))


def add(store: Store, delta: DataFrame, kinds: Mapping[str, str], stream: str | None = None, batch: int | None = None) -> bool:
    """Adds delta's states to the stored ones. With a stream's name and a batch's number, a batch that was added before is passed over, so that one
    that is replayed counts once: the number is committed with the states."""
    m = store.manifest()
    if stream is not None and batch <= m.notes.get(stream, -1):
        return False
    store.merge(delta, lambda old, new: merged(old, new, m.keys, kinds), notes={stream: batch} if stream is not None else None)
    return True


def reconciled(store: Store, recount: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Gives the store the recount; keys, and for each measure the stored and the counted value (null where a side lacks the key), of keys that drifted."""
    keys = store.manifest().keys
    recount = materialise(recount.select(*keys, *kinds))
    both = store.read().select(*keys, F.struct(*kinds).alias("s"), F.lit(None).alias("c")).unionByName(recount.select(*keys, F.lit(None).alias("s"), F.struct(*kinds).alias("c")))
    sides = both.groupBy(*keys).agg(F.max("s").alias("stored"), F.max("c").alias("counted"))  # a row of each side; keys may be null
    drift = materialise(sides.filter(~F.col("stored").eqNullSafe(F.col("counted"))).select(*keys, *(F.col(f"{s}.{n}").alias(f"{s}_{n}") for n in kinds for s in ("stored", "counted"))))
    store.replace(recount)
    return drift


def count_stream(rows: DataFrame, store: Store, measures: Mapping[str, tuple[str, Column]], name: str, checkpoint: str):
    """A streaming query's writer that keeps the store's counters up with a stream: start() it. Batches that are replayed count once."""
    keys, kinds = store.manifest().keys, {n: k for n, (k, _) in measures.items()}
    return rows.writeStream.foreachBatch(lambda batch, number: add(store, states(batch, keys, measures), kinds, name, number) and None).option("checkpointLocation", checkpoint).queryName(name)
