"""Call scoring: two as-of prices for each call, stance, clamped return, freezing of final scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.operators.asof import resolve


def closes(days: DataFrame, price: DataFrame, now: str) -> DataFrame:
    """ticker, day, p_call and, for each horizon h, p_h: the close on the day and the one h days later, or at now if that is earlier.

    days: different (ticker, day). A row a ticker and day, so calls meet both prices in one join.
    """
    today = F.to_date(F.lit(now).cast("timestamp_ntz"))
    asked = [F.struct(F.lit(0).alias("ahead"), F.col("day").alias("at"))] + [F.struct(F.lit(h).alias("ahead"), F.least(today, F.date_add("day", h)).alias("at")) for h in calls.HORIZONS]
    each = days.select("ticker", F.col("day").alias("base"), F.inline(F.array(*asked)).alias("ahead", "day"))
    pick = lambda h: F.max(F.when(F.col("ahead") == h, F.col("close")))
    return resolve(each, price).groupBy("ticker", F.col("base").alias("day")).agg(pick(0).alias("p_call"), *(pick(h).alias(f"p_{h}") for h in calls.HORIZONS))


def score_calls(call: DataFrame, price: DataFrame, now: str, days: DataFrame | None = None) -> DataFrame:
    """call with horizon, sign, eval_at, p_call, p_eval, score. Neutral calls stay unscored.

    days (ticker, day) may name where calls can lie, if that is cheaper to read than call; else it is taken from call.
    """
    at = F.lit(now).cast("timestamp_ntz")
    days = (call.select("ticker", F.to_date("made_at").alias("day")) if days is None else days).distinct()
    known = closes(days, price, now).withColumnsRenamed({"ticker": "__ticker", "day": "__day"})
    horizon = calls.horizon_days(F.col("timeframe"))
    asked = call.withColumns({"horizon": horizon, "sign": calls.stance(F.col("direction"), F.col("action")), "eval_at": calls.eval_at(F.col("made_at"), horizon, at)})
    joined = asked.join(known, (F.col("ticker") == F.col("__ticker")) & (F.to_date("made_at") == F.col("__day")), "left")
    p_eval = reduce(lambda w, h: w.when(F.col("horizon") == h, F.col(f"p_{h}")), calls.HORIZONS, F)
    value = F.when(F.col("sign") != 0, calls.score(F.col("sign"), F.col("p_call"), F.col("p_eval")))
    return joined.withColumn("p_eval", p_eval).withColumn("score", value).drop("__ticker", "__day", *(f"p_{h}" for h in calls.HORIZONS))


def refresh_scores(old: DataFrame, price: DataFrame, now: str) -> DataFrame:
    """old (a scored table) with final scores as they were and all others computed anew; frozen rows meet no price."""
    final = F.coalesce(calls.is_final(F.col("score"), F.col("made_at"), F.col("eval_at"), F.col("horizon")), F.lit(False))
    frozen = old.filter(final).withColumn("frozen", F.lit(True))
    again = score_calls(old.filter(~final).drop("horizon", "sign", "eval_at", "p_call", "p_eval", "score"), price, now).withColumn("frozen", F.lit(False))
    return frozen.unionByName(again)

