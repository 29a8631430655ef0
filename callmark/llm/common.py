"""What the corpus operators share: reading tables, null-safe columns, records, working tables and Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.operators.ordering import few, running
from callmark.session import kept, materialise, remove, scratch, ship, work_dir

__all__ = ["SLICE_ROWS", "few", "kept", "materialise", "name", "record", "remove", "running", "scratch", "slices", "spread_join", "table", "whole", "work_dir"]
#: Rows that a Python task turns into Python objects at one time.
SLICE_ROWS = 128
#: A key of more rows than this meets its one row of the other side by broadcast, if there are at most so many such keys.
HOT_ROWS, MOST_HOT = 1_000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def name(column: str) -> str:
    """The column's name, whatever signs are in it."""
    return "`" + column.replace("`", "``") + "`"


def whole(text: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def record(df: DataFrame, **more: Column) -> DataFrame:
    """record (a row of df as a struct) and more columns, made from df's: what is added later clashes with no name of df's."""
    return df.select(F.struct(*(F.col(name(c)) for c in df.columns)).alias("record"), *(c.alias(n) for n, c in more.items()))


def spread_join(big: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """big joined with small, which has a row for each key and says in column size how many rows of big have it.

    Keys that very many rows have would each gather in one task; their rows of small, of which there are few, are broadcast.
    """
    hot = small.filter(F.col(size) > HOT_ROWS)
    number = hot.limit(MOST_HOT + 1).count()
    if not 0 < number <= MOST_HOT:
        return big.join(small, key)
    hot = F.broadcast(hot)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(small.filter(F.col(size) <= HOT_ROWS), key))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that few rows are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
