"""Keyed merges, resume and sync plans: the batch forms of upserts and state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of old and new, of each key the one with the greatest order; new wins ties. One shuffle by key."""
    columns = old.columns
    both = old.withColumn("__new", F.lit(False)).unionByName(new.select(*columns).withColumn("__new", F.lit(True)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, "__new")).alias("__row"))
    return best.select("__row.*")


def upsert_filling(old: DataFrame, new: DataFrame, keys: Sequence[str], untouched: Sequence[str] = ()) -> DataFrame:
    """Of each key new's columns, where they are null old's; untouched columns keep old's value. ``inserted`` tells new keys."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("__old")), new.select(*keys, F.struct(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in rest)).alias("__new"))
    pick = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in untouched else F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}"))
    return a.join(b, list(keys), "full").select(*keys, *(pick(c).alias(c) for c in rest), F.col("__old").isNull().alias("inserted"))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old, list(keys), "left_anti").select(*old.columns))


def replace_run(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of a run are replaced as a whole, so that loading it again changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def promote(items: DataFrame, runs: DataFrame, item: str = "item_id", run: str = "run") -> DataFrame:
    """items with primary_run: of the item's finished runs that were not for comparison the latest; else what it was, if anything.

    items: item, primary_run; runs: item, run, finished_at, done, compares.
    """
    latest = runs.filter("done AND NOT compares").groupBy(item).agg(F.max_by(run, F.struct("finished_at", run)).alias("__run"))
    return items.join(latest, item, "left").withColumn("primary_run", F.coalesce("__run", "primary_run")).drop("__run")


def backfilled(rows: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    """rows with column set where it is null and the condition holds; applied again it changes nothing."""
    return rows.withColumn(column, F.when(F.col(column).isNull() & F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def sync_state(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("ticker", "day"), order: str = "fetched_at") -> DataFrame:
    """ticker, n_days, first_day, last_day over the merged prices: counted anew, so a day that comes twice counts once."""
    return upsert(old, new, keys, order).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def sync_jobs(need: DataFrame, state: DataFrame, now: str, fresh_day: Column | None = None, retry_hours: int = 168, size: int = 40) -> DataFrame:
    """ticker, start, batch, batch_start. need: ticker, first; state: ticker, status, last_day, last_synced_at."""
    at = F.lit(now).cast("timestamp_ntz")
    fresh = (F.col("status") == "ok") & (F.col("last_day") >= (fresh_day if fresh_day is not None else F.date_sub(F.to_date(at), 1)))
    failed = (F.col("status") != "ok") & (F.col("last_synced_at") > at - F.expr(f"INTERVAL {retry_hours} HOURS"))
    jobs = need.join(state, "ticker", "left").filter(~F.coalesce(fresh | failed, F.lit(False)))
    start = F.when(F.col("last_day").isNull(), F.col("first")).otherwise(F.least("first", F.date_sub("last_day", 4)))
    place = F.floor((F.row_number().over(Window.orderBy("start", "ticker")) - 1) / size)  # a row for each ticker
    jobs = jobs.select("ticker", start.alias("start")).withColumn("batch", place)
    return jobs.withColumn("batch_start", F.min("start").over(Window.partitionBy("batch")))


def longest_prefix(pages: DataFrame, run: str = "run_id", number: str = "page_num") -> DataFrame:
    """run, n_pages: how many pages from 1 on a run has without a gap."""
    placed = pages.select(run, number).distinct().withColumn("__rn", F.row_number().over(Window.partitionBy(run).orderBy(number)))
    return placed.filter(F.col(number) == F.col("__rn")).groupBy(run).agg(F.count(F.lit(1)).alias("n_pages"))


def best_prefix(pages: DataFrame, group: str, run: str = "run_id", number: str = "page_num") -> DataFrame:
    """group and the gapless pages, from 1 on, of the group's run that has most of them; the greatest run of equals."""
    placed = pages.withColumn("__rn", F.row_number().over(Window.partitionBy(group, run).orderBy(number))).filter(F.col(number) == F.col("__rn"))
    kept = placed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group, run)))
    best = kept.withColumn("__place", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("__n"), F.desc(run))))
    return best.filter("__place = 1").drop("__rn", "__n", "__place")


def pending(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The whole queue in order; with a limit its first rows."""
    queue = rows.orderBy(order)
    return queue if limit is None else queue.limit(limit)
