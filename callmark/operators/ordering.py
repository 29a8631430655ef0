"""Places and running totals in one order over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.session import materialise

#: Rows of narrow tables (sources, say) that one task orders.
FEW_ROWS = 100_000


def few(df: DataFrame, most: int) -> bool:
    """Has df at most so many rows? Reads no more of it than that."""
    return df.limit(most + 1).count() <= most


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """df with its rows' places in that order, from 0, as ``place``, and for each of sums its total over the rows before, by name.

    Up to FEW_ROWS rows are one window. More are dealt by ranges of the order into a working table that remembers its ranges; their
    sums, a row for each, are added up on the driver, and what is left is a window within each range. Order must tell all rows apart.
    """
    above = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if few(df, FEW_ROWS):
        return df.withColumns({"place": F.count(F.lit(1)).over(above), **{n: F.coalesce(F.sum(c).over(above), F.lit(0)) for n, c in sums.items()}})
    dealt = materialise(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    totals = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("place"), *(F.sum(c).alias(n) for n, c in sums.items())).orderBy("part_").collect()
    ahead, rows = dict.fromkeys(("place", *sums), 0), []
    for r in totals:  # as many as shuffle partitions
        rows.append((r["part_"], *ahead.values()))
        ahead = {n: a + (r[n] or 0) for n, a in ahead.items()}
    names = [f"{n}_" for n in ahead]
    types = ["long", *(dealt.select(c.alias("x")).agg(F.sum("x")).schema[0].dataType.simpleString() for c in sums.values())]
    before = df.sparkSession.createDataFrame(rows, "part_ int, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({"place": F.count(F.lit(1)).over(within), **{n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}})
    return own.join(F.broadcast(before), "part_").withColumns({n: F.col(n) + F.col(f"{n}_") for n in ahead}).drop("part_", *names)
