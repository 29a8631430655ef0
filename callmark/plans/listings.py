"""Listings: sources, dashboard, channels, items, calls, runs, details, progress, catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.operators.listing import call_order, filter_items, page, page_with_total, scored_filter
from callmark.operators.listing_store import Listing, write_listing
from callmark.plans.leaderboards import scored
from callmark.plans.registry import query
from callmark.session import materialise, work_dir
from callmark.sources.domain import NOW, Domain




@query("SELECT source_id, source, count(item_id) AS n_items FROM source LEFT JOIN (SELECT * FROM item WHERE status <> 'error' AND source_id <> 2) USING (source_id) GROUP BY ALL")
def source_list(d: Domain) -> DataFrame:
    items = d.item.filter("status <> 'error' AND source_id <> 2").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return d.source.join(items, "source_id", "left").select("source_id", "source", F.coalesce("n", F.lit(0)).alias("n_items"))


DASH = """count(*) AS n_items, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) FILTER (WHERE status = 'pending') AS n_pending, count(*) FILTER (WHERE status = 'error') AS n_error,
count(DISTINCT channel_id) AS n_channels, count(DISTINCT channel_id) FILTER (WHERE status = 'done') AS n_channels_done, min(published_at) AS first_at, max(published_at) AS last_at, round(coalesce(sum(length), 0), 2) AS length"""


@query(f"SELECT source, {DASH} FROM item JOIN source USING (source_id) GROUP BY source UNION ALL SELECT NULL, {DASH} FROM item")
def dashboard(d: Domain) -> DataFrame:
    """A row for each source and one, without source, for all: one pass with a rollup."""
    done = F.col("status") == "done"
    cents = F.sum(F.round(F.col("length") * 100).cast("long"))
    rows = d.item.join(F.broadcast(d.source), "source_id").rollup("source").agg(
        F.count(F.lit(1)).alias("n_items"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("done", "pending", "error")), F.countDistinct("channel_id").alias("n_channels"),
        F.countDistinct(F.when(done, F.col("channel_id"))).alias("n_channels_done"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.round(F.coalesce(cents, F.lit(0)) / 100, 2).alias("length"))
    return rows


@query("""SELECT channel.channel_id, handle, source, count(DISTINCT item_id) AS n_items, count(call_id) AS n_calls, count(score) AS n_scored, round(avg(score), 6) AS avg_score, max(published_at) AS last_item_at
FROM channel JOIN source USING (source_id) LEFT JOIN item USING (channel_id) LEFT JOIN primary_scored USING (item_id) GROUP BY channel.channel_id, handle, source""")
def channel_directory(d: Domain) -> DataFrame:
    """Calls are summed by item before items meet channels, so nothing fans out."""
    by_item = scored(d, d.primary_call).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count("score").alias("n_scored"), F.sum("score").alias("total"))
    by_channel = d.item.join(by_item, "item_id", "left").groupBy("channel_id").agg(F.count(F.lit(1)).alias("n_items"), *(F.sum(c).alias(c) for c in ("n_calls", "n_scored", "total")), F.max("published_at").alias("last_item_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    owner = d.channel.join(F.broadcast(d.source), "source_id").select("channel_id", "handle", "source")
    return owner.join(by_channel, "channel_id", "left").select("channel_id", "handle", "source", zero("n_items"), zero("n_calls"), zero("n_scored"), F.round(F.try_divide("total", "n_scored"), 6).alias("avg_score"), "last_item_at")


def items_with_source(d: Domain) -> DataFrame:
    return d.named_item.join(F.broadcast(d.source), "source_id")


@query("""SELECT item_id, source, handle, published_at, status, item_id IN (SELECT item_id FROM primary_call) AS has_calls FROM item JOIN source USING (source_id) LEFT JOIN channel USING (channel_id)
WHERE source IN ('ASIA', 'EUROPE') AND published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '1999-01-01' ORDER BY published_at DESC NULLS LAST, item_id DESC LIMIT 200 OFFSET 10""")
def list_items(d: Domain) -> DataFrame:
    rows = filter_items(items_with_source(d), d.primary_call, sources=["ASIA", "EUROPE"], first="1996-01-01", last="1998-12-31")
    top = materialise(page(rows.select("item_id", "source", "handle", "published_at", "status"), [F.desc_nulls_last("published_at"), F.desc("item_id")], 1_000, 10))  # a page, which is read twice
    has = d.call.join(F.broadcast(top.select("item_id")), "item_id", "left_semi").select("item_id", F.lit(True).alias("has_calls")).distinct()  # an item with any call has a primary one; at most a page's
    return top.join(has, "item_id", "left").withColumn("has_calls", F.coalesce("has_calls", F.lit(False)))


@query("""+ found AS (SELECT item_id, source, handle, published_at, status FROM item JOIN source USING (source_id) LEFT JOIN channel USING (channel_id)), n AS (SELECT count(*) AS total FROM found)
SELECT found.*, total FROM found, n ORDER BY published_at DESC NULLS LAST, item_id DESC LIMIT 50 OFFSET (SELECT total // 2 FROM n)""")
def deep_page(d: Domain) -> DataFrame:
    """A page in the middle of all items, out of a listing that is sorted once: one range is read, and the total is a sum of counts."""
    order = [F.desc_nulls_last("published_at"), F.desc("item_id")]
    path = work_dir(d.spark)
    write_listing(items_with_source(d).select("item_id", "source", "handle", "published_at", "status"), order, path)
    listing = Listing(d.spark, path, order)
    return listing.page(listing.total // 2, 50).withColumn("total", F.lit(listing.total).cast("long"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done FROM item WHERE item_id NOT IN (SELECT item_id FROM primary_call WHERE direction = 'up')")
def items_without_calls(d: Domain) -> DataFrame:
    """The total beside a page; items that were never extracted count as being without calls."""
    rows = filter_items(d.item, d.primary_call.filter("direction = 'up'"), has_calls=False)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"))


@query("""+ found AS (SELECT item_id, source, published_at, count(*) OVER () AS total FROM item JOIN source USING (source_id) WHERE status = 'error')
SELECT item_id, source, published_at, total, 50::INTEGER AS "limit", 100::INTEGER AS "offset" FROM found ORDER BY published_at DESC NULLS LAST, item_id DESC LIMIT 50 OFFSET 100""")
def counted_page(d: Domain) -> DataFrame:
    """A page of failed items and, on each of its rows, how many there are in all."""
    rows = filter_items(items_with_source(d).filter("status = 'error'").select("item_id", "source", "published_at"), d.primary_call)
    return page_with_total(rows, [F.desc_nulls_last("published_at"), F.desc("item_id")], 50, 100)


@query("""SELECT item_id, source, published_at, status FROM item JOIN source USING (source_id) WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at < TIMESTAMP '1999-01-01'""")
def list_all_items(d: Domain) -> DataFrame:
    """A listing without a limit: every item between two days, in order."""
    rows = filter_items(d.item.join(F.broadcast(d.source), "source_id"), d.primary_call, first="1996-01-01", last="1998-12-31")
    return page(rows.select("item_id", "source", "published_at", "status"), [F.desc_nulls_last("published_at"), F.desc("item_id")], None)


@query("""SELECT call_id, item_id, speaker, ticker, direction, made_at, round(score, 6) AS score, NULL::VARCHAR AS snippet FROM primary_scored JOIN item USING (item_id)
WHERE speaker ILIKE '%s1%' AND direction = 'up' AND score IS NOT NULL AND made_at >= TIMESTAMP '1996-01-01' ORDER BY score DESC NULLS LAST, call_id DESC LIMIT 200""")
def prediction_browser(d: Domain) -> DataFrame:
    """Filters of the calls browser; % and _ in the user's text stay wildcards."""
    wanted = d.primary_call.filter(F.col("speaker").ilike("%s1%") & (F.col("direction") == "up") & (F.col("made_at") >= "1996-01-01")).join(d.item.select("item_id"), "item_id", "left_semi")
    rows = scored(d, wanted).filter(scored_filter(True)).select("call_id", "item_id", "speaker", "ticker", "direction", "made_at", "score")
    return page(rows, call_order("score_desc"), 500).select("call_id", "item_id", "speaker", "ticker", "direction", "made_at", F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("snippet"))


@query("""+ runs AS (SELECT item_id, provider, model, count(*) AS n_calls, count(*) FILTER (WHERE sign <> 0) AS n_directional, max(made_at) AS last_at FROM call GROUP BY ALL)
SELECT runs.*, provider = run[1] AND model = run[2] AS is_primary FROM runs JOIN primary_run USING (item_id)""")
def item_runs(d: Domain) -> DataFrame:
    """Runs of each item with their counts; the smallest is primary. One aggregation, then a window over the runs."""
    sign = calls.stance(F.col("direction"), F.col("action"))
    runs = d.call.groupBy("item_id", "provider", "model").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(sign != 0).alias("n_directional"), F.max("made_at").alias("last_at"))
    return runs.withColumn("is_primary", F.row_number().over(Window.partitionBy("item_id").orderBy("provider", "model")) == 1)


@query("""+ a AS (SELECT * FROM call WHERE provider = 'F'), b AS (SELECT * FROM call WHERE provider = 'O'),
x AS (SELECT item_id, count(*) AS n_a, count(DISTINCT ticker) AS t_a FROM a GROUP BY item_id), y AS (SELECT item_id, count(*) AS n_b, count(DISTINCT ticker) AS t_b FROM b GROUP BY item_id),
both_ AS (SELECT item_id, count(*) AS shared FROM (SELECT DISTINCT item_id, ticker FROM a INTERSECT SELECT DISTINCT item_id, ticker FROM b) GROUP BY item_id)
SELECT coalesce(x.item_id, y.item_id) AS item_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(t_a, 0) AS t_a, coalesce(t_b, 0) AS t_b, coalesce(shared, 0) AS shared
FROM x FULL JOIN y ON x.item_id = y.item_id LEFT JOIN both_ ON both_.item_id = coalesce(x.item_id, y.item_id)""")
def run_comparison(d: Domain) -> DataFrame:
    """Two providers' runs of each item: calls, tickers, tickers in both. One aggregation by item and ticker, then by item."""
    by_ticker = d.call.groupBy("item_id", "ticker").agg(F.count_if(F.col("provider") == "F").alias("a"), F.count_if(F.col("provider") == "O").alias("b"))
    return by_ticker.groupBy("item_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(F.col("a") > 0).alias("t_a"), F.count_if(F.col("b") > 0).alias("t_b"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"))


@query("""+ k AS (SELECT *, coalesce(nullif(upper(trim(ticker)), ''), '__noticker__:' || call_id) AS key FROM primary_call)
SELECT item_id, key, count(*) AS n_calls, count(DISTINCT speaker) AS n_speakers, count(*) FILTER (WHERE sign > 0) AS bulls, count(*) FILTER (WHERE sign < 0) AS bears,
CASE WHEN bool_or(sign > 0) AND bool_or(sign < 0) THEN 'mixed' WHEN bool_or(sign > 0) THEN 'up' WHEN bool_or(sign < 0) THEN 'down' ELSE 'neutral' END AS consensus,
bool_or(sign > 0) AND bool_or(sign < 0) AS conflict, arg_min(asset_name, call_id) AS asset_name, string_agg(speaker, ',' ORDER BY call_id) AS speakers FROM k GROUP BY item_id, key""")
def consolidated_calls(d: Domain) -> DataFrame:
    """An item's calls by ticker, with their consensus; names come from the first call, quotes keep the calls' order."""
    sign = calls.stance(F.col("direction"), F.col("action"))
    rows = d.primary_call.withColumns({"key": F.coalesce(F.nullif(F.upper(F.trim("ticker")), F.lit("")), F.concat(F.lit("__noticker__:"), "call_id")), "sign": sign})
    bulls, bears = F.count_if(F.col("sign") > 0), F.count_if(F.col("sign") < 0)
    return rows.groupBy("item_id", "key").agg(
        F.count(F.lit(1)).alias("n_calls"), F.countDistinct("speaker").alias("n_speakers"), bulls.alias("bulls"), bears.alias("bears"), calls.item_consensus(bulls, bears).alias("consensus"), ((bulls > 0) & (bears > 0)).alias("conflict"),
        F.min_by("asset_name", "call_id").alias("asset_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_id", "speaker"))), lambda x: x["speaker"]), ",").alias("speakers"))


@query("""+ made AS (SELECT item_id, count(*) AS n FROM call GROUP BY item_id)
SELECT source, count(item_id) AS n_items, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) FILTER (WHERE status = 'error') AS n_error, count(n) AS n_with_calls,
max(published_at) AS last_published, max(published_at) FILTER (WHERE status = 'done') AS last_done FROM source LEFT JOIN item USING (source_id) LEFT JOIN made USING (item_id) GROUP BY source""")
def progress(d: Domain) -> DataFrame:
    """Counters of each source, counted anew."""
    made = d.call.select("item_id", F.lit(1).alias("n")).distinct()
    rows = d.item.join(made, "item_id", "left").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("status") == "done").alias("n_done"), F.count_if(F.col("status") == "error").alias("n_error"), F.count("n").alias("n_with_calls"),
        F.max("published_at").alias("last_published"), F.max(F.when(F.col("status") == "done", F.col("published_at"))).alias("last_done"))
    return d.source.join(rows, "source_id", "left").drop("source_id").fillna(0, ["n_items", "n_done", "n_error", "n_with_calls"])


@query("""SELECT coalesce(CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END, 'NULL') AS status, count(*) AS n FROM orders GROUP BY ALL""", prelude=False)
def status_histogram(d: Domain) -> DataFrame:
    status = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    return d.table("orders").groupBy(F.coalesce(status, F.lit("NULL")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT item_id, handle, length FROM item JOIN channel USING (channel_id) WHERE status = 'pending' AND (contains(lower(handle), '00001') OR contains(lower(segment), 'build'))
ORDER BY coalesce(CASE WHEN length > 400000 THEN NULL ELSE length END, 999999999), item_id LIMIT 100""")
def transcription_candidates(d: Domain) -> DataFrame:
    """Pending items of channels that hold the needle, shortest first, unknown lengths last; the limit comes after the filter."""
    rows = d.item.filter("status = 'pending'").join(d.channel, "channel_id").filter(F.lower("handle").contains("00001") | F.lower("segment").contains("build"))
    known = F.coalesce(F.when(F.col("length") <= 400_000, F.col("length")), F.lit(999_999_999))
    return rows.select("item_id", "handle", "length").orderBy(known, "item_id").limit(100)


@query(f"""+ need AS (SELECT ticker, min(made_at)::DATE - 7 AS first FROM call WHERE ticker <> '' GROUP BY ticker),
state AS (SELECT ticker, max(day) AS last_day, CASE WHEN ascii(right(ticker, 1)) % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM price WHERE ticker <> 'Brand#9' GROUP BY ticker),
job AS (SELECT need.ticker, CASE WHEN last_day IS NULL THEN first ELSE least(first, last_day - 4) END AS start FROM need LEFT JOIN state USING (ticker)
    WHERE NOT coalesce((status = 'ok' AND last_day >= DATE '{NOW[:10]}' + 490 - 1) OR status = 'error', false)),
placed AS (SELECT *, floor((row_number() OVER (ORDER BY start, ticker) - 1) / 4)::BIGINT AS batch FROM job)
SELECT ticker, start, batch, min(start) OVER (PARTITION BY batch) AS batch_start FROM placed""")
def sync_plan(d: Domain) -> DataFrame:
    """Which tickers to fetch from which day: not those up to date or lately failed; in batches of four by start."""
    from callmark.operators.incremental import sync_jobs

    last = F.ascii(F.right("ticker", F.lit(1))) % 3
    state = d.price.filter("ticker <> 'Brand#9'").groupBy("ticker").agg(F.max("day").alias("last_day")).withColumn("status", F.when(last == 0, "error").otherwise("ok"))
    need = d.call.filter("ticker <> ''").groupBy("ticker").agg(F.date_sub(F.to_date(F.min("made_at")), 7).alias("first"))
    return sync_jobs(need, state.withColumn("last_synced_at", F.lit(NOW).cast("timestamp_ntz")), NOW, fresh_day=F.date_add(F.lit(NOW[:10]).cast("date"), 489), size=4)
