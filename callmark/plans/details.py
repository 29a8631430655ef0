"""Details of items and state: an item's page, related items, entities, primary runs, backfills, sync state, the sample's topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.operators import incremental as inc
from callmark.operators import search
from callmark.plans.opinions import EVENTS, events
from callmark.plans.registry import query
from callmark.plans.search import _POOLED, pooled_items
from callmark.sources.domain import Domain

_RELATED = f"""{_POOLED}, sim AS (SELECT a.item AS item_id, b.item AS related_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM pooled a, pooled b WHERE a.item <> b.item),
related AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, related_id)::INTEGER AS place FROM sim)"""


def related(d: Domain) -> DataFrame:
    """item_id, related_id, similarity, place: the ten nearest items of each."""
    links = search.cosine_links(pooled_items(d)).withColumnsRenamed({"a": "item_id", "b": "related_id"})
    return links.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("similarity"), "related_id")))


@query(f"+ {_RELATED} SELECT r.item_id, related_id, similarity, place, published_at, handle FROM related r JOIN item i ON i.item_id = related_id LEFT JOIN channel USING (channel_id) WHERE place <= 10")
def related_items(d: Domain) -> DataFrame:
    """One hop along the links: related items with their dates and channels, nearest first."""
    there = d.named_item.select(F.col("item_id").alias("related_id"), "published_at", "handle")
    return related(d).join(there, "related_id").select("item_id", "related_id", "similarity", "place", "published_at", "handle")


_ENTITIES = """ents AS (SELECT item_id, kind, name, ticker, count(*)::DOUBLE AS weight FROM (SELECT item_id, 'asset' AS kind, asset_name AS name, ticker FROM primary_call UNION ALL SELECT item_id, 'theme', asset_class, NULL FROM view) GROUP BY ALL)"""


def entities(d: Domain) -> DataFrame:
    """item_id, kind, name, ticker, weight: what an item's calls and views name, as often as they do."""
    assets = d.primary_call.select("item_id", F.lit("asset").alias("kind"), F.col("asset_name").alias("name"), "ticker")
    both = assets.unionByName(d.view.select("item_id", F.lit("theme").alias("kind"), F.col("asset_class").alias("name"), F.lit(None).cast("string").alias("ticker")))
    return both.repartition(d.tasks("lineitem"), "item_id").groupBy("item_id", "kind", "name", "ticker").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query(f"+ {_ENTITIES} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, name, kind, ticker)::INTEGER AS place FROM ents")
def item_entities(d: Domain) -> DataFrame:
    """An item's entities, heaviest first."""
    return entities(d).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("weight"), "name", "kind", F.asc_nulls_last("ticker"))))


@query(f"""+ {_ENTITIES}, r AS (SELECT item_id, run, count(*) OVER (PARTITION BY item_id) AS n_runs, row_number() OVER (PARTITION BY item_id ORDER BY run) AS rn, n_calls, n_keys, conflicts FROM (SELECT item_id, provider || '/' || model AS run, sum(n)::BIGINT AS n_calls, count(*) AS n_keys, count(*) FILTER (WHERE up AND down) AS conflicts FROM
    (SELECT item_id, provider, model, ticker, count(*) AS n, bool_or(sign > 0) AS up, bool_or(sign < 0) AS down FROM call GROUP BY ALL) GROUP BY ALL)),
v AS (SELECT item_id, count(*) AS n_views FROM view GROUP BY item_id), e AS (SELECT item_id, count(*) AS n_entities, arg_max(name, (weight, name)) AS top_entity FROM ents GROUP BY item_id)
SELECT item.item_id, source, handle, published_at, status, run, coalesce(n_runs, 0) AS n_runs, coalesce(n_calls, 0) AS n_calls, coalesce(n_keys, 0) AS n_tickers, coalesce(conflicts, 0) AS n_conflicts, coalesce(n_views, 0) AS n_views, coalesce(n_entities, 0) AS n_entities, top_entity
FROM item JOIN source USING (source_id) LEFT JOIN channel USING (channel_id) LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.item_id = item.item_id LEFT JOIN v ON v.item_id = item.item_id LEFT JOIN e ON e.item_id = item.item_id""")
def item_detail(d: Domain) -> DataFrame:
    """What an item's page begins with: the item, its primary run with consolidated calls, other runs, views and entities."""
    n = d.tasks("lineitem")
    called = d.call.select("item_id", F.lit(False).alias("theme"), F.concat_ws("/", "provider", "model").alias("run"), "provider", "model", "ticker", F.col("asset_name").alias("name"), calls.stance(F.col("direction"), F.col("action")).alias("sign"))
    viewed = d.view.select("item_id", F.lit(True).alias("theme"), F.col("asset_class").alias("name"))
    # one shuffle and one sort of all that items name; what follows groups by ever fewer of the columns in front
    by = ["item_id", "theme", "run", "provider", "model", "ticker"]
    named = called.unionByName(viewed, allowMissingColumns=True).repartition(n, "item_id").groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"), F.max("sign").alias("most"), F.min("sign").alias("least"))
    tickers = named.groupBy(*by).agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n_names"), F.max(F.struct("n", "name")).alias("top"))
    pairs = tickers.groupBy(*by[:5]).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_tickers"), F.count_if((F.col("most") > 0) & (F.col("least") < 0)).alias("n_conflicts"), F.sum("n_names").alias("n_names"), F.max("top").alias("top"))
    runs = pairs.groupBy(*by[:3]).agg(F.sum("n").alias("n_calls"), F.sum("n_tickers").alias("n_tickers"), F.sum("n_conflicts").alias("n_conflicts"), F.min(F.struct("provider", "model", "n_names", "top")).alias("own"))
    a_run = ~F.col("theme")
    found = runs.groupBy("item_id").agg(
        F.min(F.when(a_run, F.struct("run", "n_calls", "n_tickers", "n_conflicts"))).alias("r"), F.count_if(a_run).alias("n_runs"), F.min(F.when(a_run, F.col("own"))).alias("c"), F.max(F.when(~a_run, F.struct("n_calls", "own"))).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = found.select("item_id", "r.*", "n_runs", F.col("v.n_calls").alias("n_views"), (zero("c.n_names") + zero("v.own.n_names")).alias("n_entities"), F.greatest("c.top", "v.own.top")["name"].alias("top_entity"))
    rows = d.named_item.join(F.broadcast(d.source), "source_id").repartition(n, "item_id").join(found, "item_id", "left")
    counts = ["n_runs", "n_calls", "n_tickers", "n_conflicts", "n_views", "n_entities"]
    return rows.select("item_id", "source", "handle", "published_at", "status", "run", *(zero(c).alias(c) for c in counts), "top_entity")


def of_runs(calls: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Calls of each item's chosen run (item_id, provider, model), where one is chosen, and of its primary run elsewhere. A choice of a run that the item
    does not have gives none."""
    first = F.rank().over(Window.partitionBy("item_id").orderBy("provider", "model"))
    ranked = calls.withColumn("__place", first)
    if chosen is None:
        return ranked.filter("__place = 1").drop("__place")
    asked = chosen.groupBy("item_id").agg(F.min(F.struct("provider", "model")).alias("__run"))
    mine = ranked.join(asked, "item_id", "left").filter((F.col("__run").isNull() & (F.col("__place") == 1)) | (F.col("__run") == F.struct("provider", "model")))
    return mine.drop("__place", "__run")


@query("""+ pick AS (SELECT item_id, max((provider, model)) AS run FROM call WHERE item_id % 2 = 0 GROUP BY item_id), mine AS (SELECT call.*, coalesce(pick.run, primary_run.run) AS run FROM call JOIN primary_run USING (item_id) LEFT JOIN pick USING (item_id))
SELECT item_id, 'call' AS what, call_id AS ref, provider || '/' || model AS run, speaker, ticker AS topic, direction, asset_name AS said FROM mine WHERE provider = run[1] AND model = run[2]
UNION ALL SELECT item_id, 'view', view_id::VARCHAR, NULL, speaker, asset_class, direction, rationale FROM view""")
def item_records(d: Domain) -> DataFrame:
    """All that an item's page lists: the calls of the run that the caller chose (here the last one for even items), of its primary run elsewhere, and its market views with what was said."""
    last = d.call.filter("item_id % 2 = 0").groupBy("item_id").agg(F.max(F.struct("provider", "model")).alias("r")).select("item_id", "r.*")
    own = of_runs(d.call, last).select("item_id", F.lit("call").alias("what"), F.col("call_id").alias("ref"), F.concat_ws("/", "provider", "model").alias("run"), "speaker", F.col("ticker").alias("topic"), "direction", F.col("asset_name").alias("said"))
    views = d.view.select("item_id", F.lit("view").alias("what"), F.col("view_id").cast("string").alias("ref"), F.lit(None).cast("string").alias("run"), "speaker", F.col("asset_class").alias("topic"), "direction", F.col("rationale").alias("said"))
    return own.unionByName(views)


_RUNS = "runs AS (SELECT item_id, provider || '/' || model AS run, max(made_at) AS finished_at, provider = 'F' AS done, model = 'R' AS compares FROM call GROUP BY ALL)"


@query(f"""+ {_RUNS}, best AS (SELECT item_id, arg_max(run, (finished_at, run)) AS run FROM runs WHERE done AND NOT compares GROUP BY item_id)
SELECT item_id, coalesce(run, CASE WHEN item_id % 7 = 0 THEN 'old/run' END) AS primary_run FROM item LEFT JOIN best USING (item_id)""")
def primary_runs(d: Domain) -> DataFrame:
    """Each item's primary run after promotion: runs for comparison and failed ones are never promoted."""
    runs = d.call.groupBy("item_id", F.concat_ws("/", "provider", "model").alias("run"), (F.col("provider") == "F").alias("done"), (F.col("model") == "R").alias("compares")).agg(F.max("made_at").alias("finished_at"))
    return inc.promote(d.item.select("item_id", F.when(F.col("item_id") % 7 == 0, "old/run").alias("primary_run")), runs)


@query("""+ f AS (SELECT item_id, max(made_at) AS finished FROM primary_call GROUP BY item_id)
SELECT item_id, published_at AS ingested_at, CASE WHEN item_id % 3 = 0 THEN published_at WHEN status = 'done' THEN finished END AS extracted_at, CASE WHEN item_id % 5 = 0 THEN 'done' WHEN status = 'error' THEN 'pending' END AS transcription FROM item LEFT JOIN f USING (item_id)""")
def backfills(d: Domain) -> DataFrame:
    """Columns that came later, filled once from what is known; what has a value keeps it, and a second run changes nothing."""
    finished = d.primary_call.groupBy("item_id").agg(F.max("made_at").alias("finished"))
    rows = d.item.join(finished, "item_id", "left").withColumns({"ingested_at": F.lit(None).cast("timestamp_ntz"), "extracted_at": F.when(F.col("item_id") % 3 == 0, F.col("published_at")), "transcription": F.when(F.col("item_id") % 5 == 0, "done")})
    for _ in range(2):
        rows = inc.backfilled(rows, "ingested_at", F.lit(True), F.col("published_at"))
        rows = inc.backfilled(rows, "extracted_at", F.col("status") == "done", F.col("finished"))
        rows = inc.backfilled(rows, "transcription", F.col("status") == "error", F.lit("pending"))
    return rows.select("item_id", "ingested_at", "extracted_at", "transcription")


@query("""+ a AS (SELECT ticker, day FROM price WHERE day < DATE '1999-01-01'), b AS (SELECT ticker, day FROM price WHERE day >= DATE '1998-06-01')
SELECT ticker, count(*) AS n_days, min(day) AS first_day, max(day) AS last_day FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ticker""")
def synced_tickers(d: Domain) -> DataFrame:
    """State of each ticker after new prices were merged into those at hand; days in both count once."""
    p = d.price
    return inc.sync_state(p.filter("day < '1999-01-01'").withColumn("fetched_at", F.lit(1)), p.filter("day >= '1998-06-01'").withColumn("fetched_at", F.lit(2)))


@query("SELECT status, count(*) AS n FROM item WHERE source_id = (SELECT source_id FROM source WHERE source = 'ASIA') GROUP BY status")
def source_lookup(d: Domain) -> DataFrame:
    """Items of a source that is told by its name: a join with the one row that has it."""
    one = d.source.filter("source = 'ASIA'").select("source_id")
    return d.item.join(F.broadcast(one), "source_id", "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""+ {EVENTS}, i AS (SELECT topic, item_id, max(seen_at) AS last_at FROM ev GROUP BY ALL) SELECT topic, item_id, row_number() OVER (PARTITION BY topic ORDER BY last_at DESC, item_id DESC)::INTEGER AS place FROM i""")
def ticker_items(d: Domain) -> DataFrame:
    """A ticker's source items, newest call first, each once, where it first comes up."""
    once = events(d).groupBy("topic", "item_id").agg(F.max("seen_at").alias("at"))
    return once.select("topic", "item_id", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("at"), F.desc("item_id"))).alias("place"))


@query(f"""+ {EVENTS}, n AS (SELECT channel_id, topic, count(*) AS n, min(published_at) AS first_at, max(published_at) AS last_at, count(DISTINCT year(published_at)) AS n_years FROM ev JOIN item USING (item_id) WHERE channel_id IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, topic)::INTEGER AS place FROM n) WHERE place <= 12""")
def study_topics(d: Domain) -> DataFrame:
    """The twelve topics that a channel comes back to most, and over how many years it has."""
    tasks = d.tasks("lineitem")
    by_item = events(d).select("item_id", "topic").repartition(tasks, "item_id").groupBy("item_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    owned = by_item.join(d.item.filter("channel_id IS NOT NULL").select("item_id", "channel_id", "published_at").repartition(tasks, "item_id"), "item_id").withColumn("year", F.year("published_at"))
    extent = [F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    by_year = owned.withColumns({"first_at": F.col("published_at"), "last_at": F.col("published_at")}).repartition(tasks, "channel_id", "topic", "year").groupBy("channel_id", "topic", "year").agg(*extent)
    n = by_year.repartition(tasks, "channel_id").groupBy("channel_id", "topic").agg(*extent, F.count("year").alias("n_years"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "topic"))).filter("place <= 12")
