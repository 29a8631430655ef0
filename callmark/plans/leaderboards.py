"""Leaderboards over scored calls: channels, weeks, speakers, extraction models; tickers and price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.operators.asof import asof_forward
from callmark.operators.scoring import refresh_scores, score_calls
from callmark.plans.registry import query
from callmark.sources.domain import NOW, Domain

MEASURES = "count(*) AS n_calls, count(score) AS n_scored, round(avg(score), 6) AS avg_score, round(avg(CASE WHEN score > 0 THEN 1.0 WHEN score < 0 THEN 0.0 END), 6) AS hit_rate"


def measures() -> list:
    s = F.col("score")
    return [F.count(F.lit(1)).alias("n_calls"), F.count(s).alias("n_scored"), F.round(F.avg(s), 6).alias("avg_score"), F.round(calls.hit_rate(s), 6).alias("hit_rate")]


def sums() -> list:
    """What measures() are made of, to be added up over groups of groups."""
    s = F.col("score")
    return [F.count(F.lit(1)).alias("n_calls"), F.count(s).alias("n_scored"), F.sum(s).alias("total"), F.count_if(s > 0).alias("hits"), F.count_if(s < 0).alias("misses")]


def measures_of_sums() -> list:
    n = lambda c: F.sum(c)
    return [n("n_calls").alias("n_calls"), n("n_scored").alias("n_scored"), F.round(F.try_divide(n("total"), n("n_scored")), 6).alias("avg_score"), F.round(F.try_divide(n("hits"), n("hits") + n("misses")), 6).alias("hit_rate")]


def scored(d: Domain, call: DataFrame | None = None) -> DataFrame:
    """Scored calls. The days to price come from all calls, whatever call has been joined with or filtered by: they are few and cheap to read."""
    return score_calls(d.call if call is None else call, d.price, NOW, d.call.select("ticker", F.to_date("made_at").alias("day")))


def scored_primary(d: Domain, item: DataFrame) -> DataFrame:
    """Primary calls with item's columns, scored. Runs are picked and items joined by one shuffle by item, before prices are."""
    return scored(d, d.primary_call.join(item, "item_id"))


@query("SELECT call_id, ticker, sign, horizon, round(p_call, 6) AS p_call, round(p_eval, 6) AS p_eval, round(score, 6) AS score, eval_at FROM scored")
def score_all(d: Domain) -> DataFrame:
    return scored(d).select("call_id", "ticker", "sign", "horizon", *(F.round(c, 6).alias(c) for c in ("p_call", "p_eval", "score")), "eval_at")


@query("SELECT call_id, a.ticker, round(coalesce(p.close, last), 6) AS close FROM asked a ASOF LEFT JOIN price p ON a.ticker = p.ticker AND a.call_day <= p.day LEFT JOIN last_close l ON a.ticker = l.ticker")
def asof_price(d: Domain) -> DataFrame:
    return asof_forward(d.call.select("call_id", "ticker", F.to_date("made_at").alias("day")), d.price).select("call_id", "ticker", F.round("close", 6).alias("close"))


LATER = "2001-06-30 00:00:00"


@query(f"""+ final AS (SELECT *, score IS NOT NULL AND eval_at >= made_at + to_days(horizon::INT) AS frozen FROM scored),
again AS (SELECT f.*, coalesce(e.close, l.last) AS late FROM (SELECT *, least(TIMESTAMP '{LATER}', made_at + to_days(horizon::INT)) AS new_eval FROM final) f
    ASOF LEFT JOIN price e ON f.ticker = e.ticker AND f.new_eval::DATE <= e.day LEFT JOIN last_close l ON f.ticker = l.ticker)
SELECT call_id, frozen, round(CASE WHEN frozen THEN score WHEN sign = 0 THEN NULL ELSE greatest(-1.0, least(1.0, sign * ((late - p_call) / p_call) * 5.0)) END, 6) AS score FROM again""")
def rescore(d: Domain) -> DataFrame:
    """Scores a year later: final ones stay, open ones move."""
    return refresh_scores(scored(d), d.price, LATER).select("call_id", "frozen", F.round("score", 6).alias("score"))


@query(f"SELECT channel_id, handle, source, {MEASURES} FROM primary_scored JOIN item USING (item_id) JOIN channel USING (channel_id) JOIN source ON source.source_id = channel.source_id GROUP BY channel_id, handle, source HAVING count(score) > 0")
def channel_overall(d: Domain) -> DataFrame:
    """The overall channel leaderboard: primary runs only, channels with a scored call, best first."""
    owner = d.channel.join(F.broadcast(d.source), "source_id").select("channel_id", "handle", "source")
    by_channel = scored_primary(d, d.item.select("item_id", "channel_id")).groupBy("channel_id").agg(*measures()).filter("n_scored > 0")
    return by_channel.join(owner, "channel_id").orderBy(F.desc_nulls_last("avg_score"), "channel_id")


@query("""+ page AS (SELECT channel_id, score FROM channel LEFT JOIN item USING (channel_id) LEFT JOIN primary_scored USING (item_id)
WHERE published_at >= DATE '1997-01-01' AND published_at < DATE '1998-12-31' + INTERVAL 1 DAY)
SELECT channel_id, count(score) AS n_scored, round(avg(score), 6) AS avg_score FROM page GROUP BY channel_id HAVING count(score) > 0""")
def channel_overall_between(d: Domain) -> DataFrame:
    """With a range of publication dates, inclusive; the filter turns the outer joins into inner ones."""
    item = d.item.filter((F.col("published_at") >= "1997-01-01") & (F.col("published_at") < F.date_add(F.lit("1998-12-31").cast("date"), 1)))
    by_channel = scored_primary(d, item.select("item_id", "channel_id")).groupBy("channel_id").agg(F.count("score").alias("n_scored"), F.round(F.avg("score"), 6).alias("avg_score"))
    return d.channel.select("channel_id").join(by_channel, "channel_id", "left").filter("n_scored > 0")


@query(f"SELECT channel_id, date_trunc('week', made_at)::DATE AS week_start, {MEASURES} FROM primary_scored JOIN item USING (item_id) WHERE channel_id IS NOT NULL GROUP BY ALL")
def weekly_leaderboard(d: Domain) -> DataFrame:
    rows = scored_primary(d, d.item.filter("channel_id IS NOT NULL").select("item_id", "channel_id"))
    return rows.groupBy("channel_id", F.to_date(F.date_trunc("week", "made_at")).alias("week_start")).agg(*measures())


@query(f"""+ weekly AS (SELECT channel_id, date_trunc('week', made_at)::DATE AS week_start, {MEASURES} FROM primary_scored JOIN item USING (item_id) WHERE channel_id IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY week_start ORDER BY avg_score DESC NULLS FIRST, channel_id) AS place FROM weekly
WHERE week_start >= DATE '{NOW[:10]}' - 84 AND week_start <= DATE '{NOW[:10]}'""")
def weekly_recent(d: Domain) -> DataFrame:
    """The last twelve weeks, all of their rows, newest first; place is that within the week. Unscored channels lead, as nulls do in descending order by default there."""
    today = F.lit(NOW[:10]).cast("date")
    rows = weekly_leaderboard(d).filter((F.col("week_start") >= F.date_sub(today, 84)) & (F.col("week_start") <= today))
    place = F.row_number().over(Window.partitionBy("week_start").orderBy(F.desc_nulls_first("avg_score"), "channel_id")).cast("long")
    return rows.withColumn("place", place).orderBy(F.desc("week_start"), "place")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("+ weekly AS (SELECT segment, date_trunc('week', made_at)::DATE AS week, avg(score) AS s FROM primary_scored JOIN item USING (item_id) JOIN channel USING (channel_id) GROUP BY ALL) SELECT week, " + ", ".join(f"round(max(CASE WHEN segment = '{x}' THEN s END), 6) AS {x.lower()}" for x in SEGMENTS) + " FROM weekly GROUP BY week")
def segment_pivot(d: Domain) -> DataFrame:
    """Week by channel segment, as for a chart."""
    owner = d.item.select("item_id", "channel_id").join(d.channel.select("channel_id", F.lower("segment").alias("segment")), "channel_id").drop("channel_id")
    names = [x.lower() for x in SEGMENTS]
    wide = scored_primary(d, owner).groupBy(F.to_date(F.date_trunc("week", "made_at")).alias("week")).pivot("segment", names).agg(F.avg("score"))
    return wide.select("week", *(F.round(n, 6).alias(n) for n in names))


@query(f"""+ rows AS (SELECT speaker, score, made_at, channel_id FROM primary_scored JOIN item USING (item_id)),
ranked AS (SELECT speaker, channel_id, row_number() OVER (PARTITION BY speaker ORDER BY count(*) DESC, max(made_at) DESC, channel_id) AS rn FROM rows WHERE channel_id IS NOT NULL GROUP BY speaker, channel_id),
agg AS (SELECT speaker, {MEASURES}, max(made_at) AS last_call_at FROM rows GROUP BY speaker)
SELECT agg.*, channel_id AS main_channel_id FROM agg LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) USING (speaker)""")
def speaker_leaderboard(d: Domain) -> DataFrame:
    """Speakers with their main channel, that of most calls, then of the newest, then of the smallest id."""
    rows = scored_primary(d, d.item.select("item_id", "channel_id"))
    by_channel = rows.groupBy("speaker", "channel_id").agg(*sums(), F.max("made_at").alias("last"))
    best = F.max_by("channel_id", F.when(F.col("channel_id").isNotNull(), F.struct("n_calls", "last", -F.col("channel_id"))))
    return by_channel.groupBy("speaker").agg(*measures_of_sums(), F.max("last").alias("last_call_at"), best.alias("main_channel_id"))


@query(f"""+ rows AS (SELECT provider, model, channel_id, score FROM scored JOIN item USING (item_id))
SELECT provider, model, channel_id, false AS overall, {MEASURES} FROM rows WHERE channel_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT provider, model, NULL, true, {MEASURES} FROM rows GROUP BY ALL""")
def model_leaderboard(d: Domain) -> DataFrame:
    """All runs, by model and channel and by model overall; calls without a channel count in the overall rows only."""
    rows = scored(d, d.call.join(d.item.select("item_id", "channel_id"), "item_id")).groupBy("provider", "model", "channel_id").agg(*sums())
    sets = rows.groupingSets([["provider", "model", "channel_id"], ["provider", "model"]], "provider", "model", "channel_id").agg((F.grouping("channel_id") == 1).alias("overall"), *measures_of_sums())
    return sets.filter("overall OR channel_id IS NOT NULL")


@query("""+ first AS (SELECT ticker, arg_min(asset_name, call_id) FILTER (WHERE asset_name IS NOT NULL) AS asset_name, count(*) AS n_calls, count(score) AS n_scored, round(avg(score), 6) AS avg_score,
round(avg(CASE WHEN score > 0 THEN 1.0 WHEN score < 0 THEN 0.0 END), 6) AS hit_rate FROM scored WHERE ticker <> '' GROUP BY ticker),
state AS (SELECT ticker, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM price GROUP BY ticker) SELECT * FROM first LEFT JOIN state USING (ticker)""")
def ticker_directory(d: Domain) -> DataFrame:
    state = d.price.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    first = F.min_by("asset_name", F.when(F.col("asset_name").isNotNull(), F.col("call_id")))
    return scored(d).filter("ticker <> ''").groupBy("ticker").agg(first.alias("asset_name"), *measures()).join(state, "ticker", "left")


@query("""+ n AS (SELECT ticker, day, close, row_number() OVER (PARTITION BY ticker ORDER BY day) AS rn, count(*) OVER (PARTITION BY ticker) AS total FROM price WHERE day >= DATE '1996-01-01')
SELECT ticker, day, round(close, 6) AS close FROM n WHERE total <= 50 OR rn % ceil(total / 50.0)::BIGINT = 0""")
def price_series(d: Domain) -> DataFrame:
    """At most 50 points a ticker: every step-th, where step is the number of points over 50, rounded up."""
    by_day, all_days = Window.partitionBy("ticker").orderBy("day"), Window.partitionBy("ticker")
    rows = d.price.filter("day >= '1996-01-01'").withColumn("rn", F.row_number().over(by_day)).withColumn("total", F.count(F.lit(1)).over(all_days))
    return rows.filter((F.col("total") <= 50) | (F.col("rn") % F.ceil(F.col("total") / 50) == 0)).select("ticker", "day", F.round("close", 6).alias("close"))


@query("""+ called AS (SELECT call_id, ticker, made_at::DATE - 7 AS since FROM primary_call)
SELECT call_id, c.ticker, round((last - close) / close * 100, 6) AS moved FROM called c ASOF JOIN price p ON c.ticker = p.ticker AND c.since <= p.day JOIN last_close l ON c.ticker = l.ticker""")
def move_since_call(d: Domain) -> DataFrame:
    """Percent from the first close on or after a week before the call to the last close of all; calls without one are left out."""
    last = d.price.groupBy("ticker").agg(F.max_by("close", "day").alias("last"))
    since = d.primary_call.select("call_id", "ticker", F.date_sub(F.to_date("made_at"), 7).alias("day"))
    moved = F.round(F.try_divide(F.col("last") - F.col("close"), F.col("close")) * 100, 6)
    return asof_forward(since, d.price, fall_back=False).filter("close IS NOT NULL").join(last, "ticker").select("call_id", "ticker", moved.alias("moved"))
