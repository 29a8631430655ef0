"""As-of joins: the first close on or after a day, else the last close of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(days: DataFrame, prices: DataFrame, key: str = "ticker", day: str = "day", value: str = "close", fall_back: bool = True) -> DataFrame:
    """days (key, day and any other columns) with ``value``, its first one on or after the day.

    Without one the last value of all stands in, unless fall_back is False. Prices without a value do not count.
    days should be different days of different keys, not the rows that ask for them: a key's window then has no more rows
    than the calendar has days, however many rows ask.
    """
    own = [c for c in days.columns if c not in (key, day)]
    known = prices.filter(F.col(value).isNotNull()).select(F.col(key).alias("__key"), F.col(day).alias("__day"), F.col(value).alias("__value"))
    asked = days.select(F.col(key).alias("__key"), F.col(day).alias("__day"), F.lit(None).cast(known.schema["__value"].dataType).alias("__value"), F.struct(F.lit(True).alias("__asks"), *own).alias("__own"))
    both = asked.unionByName(known.withColumn("__own", F.lit(None).cast(asked.schema["__own"].dataType)))
    newest_first = Window.partitionBy("__key").orderBy(F.desc("__day"), F.col("__own").isNotNull())
    found = F.last("__value", ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if fall_back:
        found = F.coalesce(found, F.first("__value", ignorenulls=True).over(newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    filled = both.withColumn("__found", found).filter("__own IS NOT NULL")
    return filled.select(F.col("__key").alias(key), F.col("__day").alias(day), *(F.col(f"__own.{c}").alias(c) for c in own), F.col("__found").alias(value))


def asof_forward(lookups: DataFrame, prices: DataFrame, key: str = "ticker", day: str = "day", value: str = "close", fall_back: bool = True) -> DataFrame:
    """lookups with ``value``; lookups must have ``key`` and ``day``, prices ``key``, ``day``, ``value``.

    The different (key, day) pairs are resolved once and joined to the lookups by both, so the lookups are shuffled once, by
    key and day, and never windowed: their parallelism grows with the data.
    """
    return lookups.join(resolve(lookups.select(key, day).distinct(), prices, key, day, value, fall_back), [key, day], "left")
