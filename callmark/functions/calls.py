"""Column functions of dated market calls: horizon, stance, score, finality, ticker hygiene, consensus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Actions with a stance of their own, and what a ticker may look like.
BULL_ACTIONS, BEAR_ACTIONS = ("buy", "long", "cover"), ("sell", "short", "avoid")
TICKER = r"^[A-Z0-9^.=:\-]{1,12}(\.[A-Z]{1,4})?$"
LEVERAGE = 5.0
#: What horizon_days can give.
HORIZONS = (7, 14, 90, 365)


def horizon_days(timeframe: Column) -> Column:
    """Days until a call is judged; the first rule that fits counts, without any 90."""
    t = F.lower(F.coalesce(timeframe, F.lit("")))
    return (
        F.when(t.contains("day") | t.endswith("d"), 7).when(t.contains("week") | t.contains("wk"), 14)
        .when(t.contains("month") | t.endswith("m"), 90).when(t.contains("q"), 90)
        .when(t.contains("year") | t.endswith("y"), 365).otherwise(90)
    )


def stance(direction: Column, action: Column) -> Column:
    """1, -1 or 0; a bullish direction or action wins over a bearish one."""
    d, a = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (direction, action))
    return F.when((d == "up") | a.isin(*BULL_ACTIONS), 1).when((d == "down") | a.isin(*BEAR_ACTIONS), -1).otherwise(0)


def stance_label(sign: Column) -> Column:
    return F.when(sign > 0, "bullish").when(sign < 0, "bearish").otherwise("neutral")


def view_stance(direction: Column) -> Column:
    d = F.lower(F.trim(direction))
    return F.when(d.isin("bullish", "bearish"), d).otherwise("neutral")


def score(sign: Column, at_call: Column, at_eval: Column) -> Column:
    """Return in the call's direction times LEVERAGE, kept within -1 and 1; null without prices, 0 for a neutral call."""
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sign * F.try_divide(at_eval - at_call, at_call) * LEVERAGE))
    return F.when(at_call.isNull() | at_eval.isNull() | (at_call == 0), None).when(sign == 0, 0.0).otherwise(value)


def add_days(at: Column, days: Column) -> Column:
    return at + F.make_dt_interval(days=days)


def eval_at(made_at: Column, days: Column, now: Column) -> Column:
    return F.least(now, add_days(made_at, days))


def is_final(value: Column, made_at: Column, evaluated: Column, days: Column) -> Column:
    return value.isNotNull() & F.coalesce(evaluated >= add_days(made_at, days), F.lit(False))


def hit_rate(value: Column) -> Column:
    """Share of positive scores among those that are not 0."""
    return F.avg(F.when(value > 0, 1.0).when(value < 0, 0.0))


def ticker(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return F.when(t.rlike(TICKER), t)


def asset_name(raw: Column, name: Column) -> Column:
    """A ticker that is none becomes the asset's name, if that is blank."""
    return F.when(ticker(raw).isNull() & (F.coalesce(F.trim(name), F.lit("")) == "") & raw.isNotNull(), F.initcap(F.trim(raw))).otherwise(name)


def topic_key(raw: Column, name: Column) -> Column:
    return F.coalesce(ticker(raw), F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(raw), F.lit("")))


def item_consensus(bulls: Column, bears: Column) -> Column:
    return F.when((bulls > 0) & (bears > 0), "mixed").when(bulls > 0, "up").when(bears > 0, "down").otherwise("neutral")


def ticker_consensus(bulls: Column, bears: Column) -> Column:
    return F.when(bulls > bears, "bullish").when(bears > bulls, "bearish").when(bulls > 0, "mixed (conflict)").otherwise("neutral / watch")
