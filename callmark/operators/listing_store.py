"""Deep pages: a listing that is sorted once into ranges with their counts, so that any page reads the ranges that it lies in, and the total is a sum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_ROWS = 100_000
PART, NUMBER = "__part", "__rows"


def write_listing(rows: DataFrame, order: Sequence[Column], path: str, range_rows: int = RANGE_ROWS) -> None:
    """Writes rows to a new folder, in ranges of the order of about so many rows, and beside them how many each has. The order must tell all rows apart."""
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(ranges, *order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    dealt.write.partitionBy(PART).parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/schema")  # a listing without rows has no other file
    counts = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias(NUMBER))
    counts.coalesce(1).write.parquet(f"{path}/counts")


class Listing:
    """A listing that was written: its schema, the counts of its ranges and their sum; rows are read page by page."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[Column]):
        self.spark, self.path, self.order = spark, path, list(order)
        self.schema = spark.read.parquet(f"{path}/schema").schema
        counts = sorted((r[PART], r[NUMBER]) for r in spark.read.parquet(f"{path}/counts").collect())  # a row for each range
        self.parts = [p for p, _ in counts]
        self.ends = np.cumsum([n for _, n in counts]) if counts else np.zeros(0, np.int64)

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows from offset on, in order; none beyond the end."""
        offset, limit = max(0, offset), max(0, limit)
        first, last = np.searchsorted(self.ends, offset, "right"), np.searchsorted(self.ends, min(offset + limit, self.total))
        if limit == 0 or first >= len(self.parts):
            return self.spark.createDataFrame([], self.schema)
        before = int(self.ends[first - 1]) if first else 0
        own = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/rows/{PART}={p}" for p in self.parts[first : last + 1]))
        return own.orderBy(*self.order).offset(offset - before).limit(limit)
