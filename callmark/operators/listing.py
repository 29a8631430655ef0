"""Filters, order and paging of listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def between_days(column: str, first: str | None, last: str | None) -> list[Column]:
    """Both days inclusive, as a half-open range, so that the filter reaches the scan."""
    out = [F.col(column) >= F.lit(first).cast("timestamp_ntz")] if first else []
    return out + ([F.col(column) < F.lit(str(date.fromisoformat(last) + timedelta(days=1))).cast("timestamp_ntz")] if last else [])


def filter_items(items: DataFrame, with_calls: DataFrame, sources: Sequence[str] = (), channels: Sequence[int] = (), first: str | None = None, last: str | None = None, has_calls: bool | None = None) -> DataFrame:
    """An empty list or None filters nothing. has_calls False keeps items without a primary run as well."""
    wanted = ([F.col("source").isin(*sources)] if sources else []) + ([F.col("channel_id").isin(*channels)] if channels else []) + between_days("published_at", first, last)
    out = items.filter(all_of(wanted))
    if has_calls is None:
        return out
    return out.join(with_calls.select("item_id").distinct(), "item_id", "left_semi" if has_calls else "left_anti")


def page(df: DataFrame, order: Sequence[Column], limit: int | None = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """Rows after offset in that order, limit kept within 1 and most: a top-k, not a sort of everything. None lists all."""
    rows = df.orderBy(*order).offset(max(0, offset))
    return rows if limit is None else rows.limit(max(1, min(limit, most)))


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """page() with total (how many rows df has), limit and offset on each row; the count is one row, so it is broadcast."""
    limit, offset = max(1, min(limit, most)), max(0, offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, limit, offset, most).join(F.broadcast(total)).select("*", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


def scored_filter(wanted: bool | None) -> Column:
    """True: scored calls; False: calls without a score; None: all."""
    return F.lit(True) if wanted is None else F.col("score").isNotNull() if wanted else F.col("score").isNull()


def call_order(name: str) -> list[Column]:
    """Recent if the name is not known."""
    first = {"score_desc": F.desc_nulls_last("score"), "score_asc": F.asc_nulls_last("score")}.get(name, F.desc_nulls_last("made_at"))
    return [first, F.desc("call_id")]

