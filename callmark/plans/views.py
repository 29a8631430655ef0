"""Market views beside calls: one stream of opinions, people's pages, themes' voices, what is said about rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls
from callmark.functions.themes import RATES_CONTEXT, THEMES
from callmark.operators import opinions as op
from callmark.plans.opinions import ALIASES, EVENTS, PART_THEMES, events, tagged, theme_sql
from callmark.plans.registry import query
from callmark.session import materialise
from callmark.sources.domain import Domain

#: Who hosts which shows: parts of their names.
HOSTS = {"S One": ["#00000000"], "S5": ["1", "7"], "S9": ["customer"]}


def _person_sql(of: str) -> str:
    return f"CASE WHEN {of} = 'S3' OR {of} = '' THEN NULL WHEN {of} = 'S1' THEN 'S One' WHEN {of} = 'S2' THEN 'S Two' ELSE {of} END"


_VIEW_EVENTS = theme_sql("vt", THEMES, "view_id::VARCHAR AS ref, item_id, person, '{theme}' AS topic, stance, seen_at")
ALL_EVENTS = f"""{EVENTS}, vt AS (SELECT *, {_person_sql("speaker")} AS person, lower(asset_class || ' ' || coalesce(rationale, '')) AS low, CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS stance FROM view),
vev AS ({_VIEW_EVENTS}), evs AS (SELECT 'call' AS what, ref, item_id, person, topic, stance, seen_at FROM ev UNION ALL SELECT 'view', ref, item_id, person, topic, stance, seen_at FROM vev)"""


def person(speaker: str | Column = "speaker") -> Column:
    return op.resolve_person(F.col(speaker) if isinstance(speaker, str) else speaker, ALIASES, generic=("s3",))


def view_rows(d: Domain) -> DataFrame:
    """Views with person, stance and themes."""
    side = calls.view_stance(F.col("direction"))
    return d.view.withColumns({"person": person(), "stance": F.when(side == "bullish", 1).when(side == "bearish", -1).otherwise(0), "themes": op.themes_of(F.concat_ws(" ", "asset_class", "rationale"))})


def all_events(d: Domain) -> DataFrame:
    """Calls by topic and views by theme in one shape; a view of several themes is several events, one of none is none."""
    views = view_rows(d).select(F.lit("view").alias("what"), F.col("view_id").cast("string").alias("ref"), "item_id", "person", F.explode("themes").alias("topic"), "stance", "seen_at")
    return events(d).select(F.lit("call").alias("what"), "ref", "item_id", "person", "topic", "stance", "seen_at").unionByName(views)


@query(f"+ {ALL_EVENTS} SELECT * FROM evs")
def opinion_events(d: Domain) -> DataFrame:
    return all_events(d)


@query(f"+ {ALL_EVENTS}, sided AS (SELECT *, lag(stance) OVER w AS prev_stance, lag(seen_at) OVER w AS prev_at FROM evs WHERE stance <> 0 AND person IS NOT NULL WINDOW w AS (PARTITION BY person, topic ORDER BY seen_at, ref)) SELECT person, topic, ref, stance, seen_at, prev_at FROM sided WHERE prev_stance = -stance AND seen_at > prev_at")
def event_shifts(d: Domain) -> DataFrame:
    """Changes of mind over calls and views alike, newest first."""
    found = op.flips(all_events(d).filter("person IS NOT NULL"), ["person", "topic"])
    return found.select("person", "topic", "ref", "stance", "seen_at", "prev_at").orderBy(F.desc("seen_at"), "ref")


_FLIPS = "lagged AS (SELECT person, topic, seen_at, stance, lag(stance) OVER w AS ps, lag(seen_at) OVER w AS pa FROM evs WHERE stance <> 0 AND person IS NOT NULL WINDOW w AS (PARTITION BY person, topic ORDER BY seen_at, ref)), flipped AS (SELECT person, count(*) AS n_flips FROM lagged WHERE ps = -stance AND seen_at > pa GROUP BY person)"


@query(f"""+ {ALL_EVENTS}, {_FLIPS}, p AS (SELECT person, count(*) FILTER (WHERE what = 'call') AS n_calls, count(*) FILTER (WHERE what = 'view') AS n_views, count(DISTINCT topic) AS n_topics,
count(*) FILTER (WHERE stance = 1) AS bullish, count(*) FILTER (WHERE stance = -1) AS bearish, count(*) FILTER (WHERE stance = 0) AS neutral, min(seen_at) AS first_at, max(seen_at) AS last_at FROM evs WHERE person IS NOT NULL GROUP BY person)
SELECT p.*, coalesce(n_flips, 0) AS n_flips, replace(lower(person), ' ', '-') AS slug FROM p LEFT JOIN flipped USING (person)""")
def person_page(d: Domain) -> DataFrame:
    """What a person's page begins with: calls, views, topics, the mix of stances, changes of mind, first and last day. One pass by person and topic, then by person."""
    rows = all_events(d).filter("person IS NOT NULL")
    before = Window.partitionBy("person", "topic").orderBy("seen_at", "ref").rowsBetween(Window.unboundedPreceding, -1)
    last_side = F.last(F.when(F.col("stance") != 0, F.struct("stance", "seen_at")), ignorenulls=True).over(before)
    flip = (F.col("stance") != 0) & (F.col("prev.stance") == -F.col("stance")) & (F.col("seen_at") > F.col("prev.seen_at"))
    n = lambda c: F.count_if(c)
    topics = rows.withColumn("prev", last_side).groupBy("person", "topic").agg(
        n(F.col("what") == "call").alias("n_calls"), n(F.col("what") == "view").alias("n_views"), n(F.col("stance") == 1).alias("bullish"), n(F.col("stance") == -1).alias("bearish"), n(F.col("stance") == 0).alias("neutral"),
        n(flip).alias("n_flips"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))
    people = topics.groupBy("person").agg(*(F.sum(c).alias(c) for c in ("n_calls", "n_views", "bullish", "bearish", "neutral", "n_flips")), F.count(F.lit(1)).alias("n_topics"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    return op.person_slugs(people)


@query(f"""+ {ALL_EVENTS}, n AS (SELECT person, topic, count(*) AS n, coalesce(arg_max(stance, (seen_at, ref)) FILTER (WHERE stance <> 0), arg_max(stance, (seen_at, ref))) AS now, arg_max(stance, (seen_at, ref)) AS last FROM evs WHERE person IS NOT NULL GROUP BY ALL),
sides AS (SELECT topic, count(*) FILTER (WHERE last = 1) AS up, count(*) FILTER (WHERE last = -1) AS down FROM n GROUP BY topic)
SELECT person, topic, n, now, CASE now WHEN 1 THEN down WHEN -1 THEN up ELSE 0 END AS n_opposed, row_number() OVER (PARTITION BY person ORDER BY n DESC, topic)::INTEGER AS place FROM n JOIN sides USING (topic)""")
def person_topic_pages(d: Domain) -> DataFrame:
    """A person's topics, most events first: how many, where they stand now, and how many others' last event is against that."""
    mine = materialise(op.current_stance(all_events(d).filter("person IS NOT NULL"), ["person", "topic"], n=F.count(F.lit(1)), last=F.max_by("stance", F.struct("seen_at", "ref"))))
    sides = mine.groupBy("topic").agg(F.count_if(F.col("last") == 1).alias("up"), F.count_if(F.col("last") == -1).alias("down"))
    place = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "topic"))
    opposed = F.when(F.col("stance") == 1, F.col("down")).when(F.col("stance") == -1, F.col("up")).otherwise(F.lit(0))
    return mine.join(sides, "topic").select("person", "topic", "n", F.col("stance").alias("now"), opposed.alias("n_opposed"), place.alias("place"))


_TAGS = theme_sql("tt", PART_THEMES, "ref, '{theme}' AS theme")


@query(f"""+ {ALL_EVENTS}, tt AS (SELECT ref, lower(kind || ' ' || asset_name) AS low FROM ev), tag AS ({_TAGS}), v AS (SELECT theme, person FROM tag JOIN ev USING (ref) UNION ALL SELECT topic, person FROM vev),
n AS (SELECT theme, person, count(*) AS n FROM v WHERE person IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, person)::INTEGER AS place FROM n) WHERE place <= 10""")
def theme_voices(d: Domain) -> DataFrame:
    """The ten people with most calls and views of each theme."""
    both = tagged(d).select("theme", "person").unionByName(view_rows(d).select(F.explode("themes").alias("theme"), "person"))
    n = both.filter("person IS NOT NULL").groupBy("theme", "person").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("n"), "person"))).filter("place <= 10")


@query(f"""SELECT view_id, seen_at, direction, speaker FROM view WHERE regexp_matches(lower(asset_class || ' ' || coalesce(rationale, '')), '{op.keyword_pattern(RATES_CONTEXT)}') ORDER BY seen_at DESC, view_id DESC LIMIT 6""")
def rates_backdrop(d: Domain) -> DataFrame:
    """The six newest views on rates, the backdrop of every other ticker's page."""
    said = F.lower(F.concat_ws(" ", "asset_class", "rationale")).rlike(op.keyword_pattern(RATES_CONTEXT))
    return d.view.filter(said).select("view_id", "seen_at", "direction", "speaker").orderBy(F.desc("seen_at"), F.desc("view_id")).limit(6)


@query("SELECT channel_id, direction, count(*) AS n FROM view JOIN item USING (item_id) WHERE channel_id IS NOT NULL GROUP BY ALL")
def channel_directions(d: Domain) -> DataFrame:
    """The mix of directions of each channel's market views."""
    return d.view.select("item_id", "direction").join(d.item.filter("channel_id IS NOT NULL").select("item_id", "channel_id"), "item_id").groupBy("channel_id", "direction").agg(F.count(F.lit(1)).alias("n"))


# an item's speakers as its extraction tells them: a JSON array, in order
_SPOKEN = f"""said AS (SELECT item_id, list_sort(list_distinct(list(speaker))) AS l FROM primary_call GROUP BY item_id), spoke AS (SELECT item_id, unnest(l) AS speaker, unnest(range(1, len(l) + 1)) AS i FROM said),
known AS (SELECT item_id, {_person_sql("speaker")} AS person, min(i) AS i FROM spoke GROUP BY ALL), speakers AS (SELECT item_id, person, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS place FROM known WHERE person IS NOT NULL)"""


def item_people(d: Domain) -> DataFrame:
    """item_id, place, person: the speakers array of each item's primary extraction, resolved; a person counts once, where first named."""
    raw = F.to_json(F.struct(F.array_sort(F.collect_set("speaker")).alias("speakers")))
    told = d.primary_call.groupBy("item_id").agg(raw.alias("raw")).select("item_id", F.from_json("raw", "struct<speakers: array<string>>")["speakers"].alias("speakers"))
    named = F.array_distinct(F.filter(F.transform("speakers", person), lambda p: p.isNotNull()))  # keeps first places
    return told.select("item_id", F.posexplode(named).alias("place", "person"))


@query(f"+ {_SPOKEN} SELECT item_id, place, person FROM speakers")
def item_speakers(d: Domain) -> DataFrame:
    return item_people(d).select("item_id", F.col("place").cast("long").alias("place"), "person")


_HOST = " OR ".join(f"person = '{who}' AND contains(lower(handle), '{part.lower()}')" for who, parts in HOSTS.items() for part in parts)


@query(f"""+ {_SPOKEN}, a AS (SELECT item_id, person, channel_id, CASE WHEN {_HOST} THEN 'host' WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN 'guest' ELSE 'solo' END AS role FROM speakers JOIN item USING (item_id) JOIN channel USING (channel_id))
SELECT channel_id, person, count(*) AS appearances, array_to_string(list_sort(list_distinct(list(role))), '/') AS roles, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, person)::INTEGER AS place FROM a GROUP BY channel_id, person""")
def channel_people(d: Domain) -> DataFrame:
    """Who appears on a channel, how often and as what; hosts are told by their shows' names."""
    owner = d.item.select("item_id", "channel_id").join(d.channel.select("channel_id", "handle"), "channel_id")
    rows = item_people(d).withColumn("n_people", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).join(owner, "item_id")
    named = rows.withColumn("role", op.role(op.hosts(F.col("person"), F.col("handle"), HOSTS), F.col("n_people")))
    n = named.groupBy("channel_id", "person").agg(F.count(F.lit(1)).alias("appearances"), F.array_join(F.sort_array(F.collect_set("role")), "/").alias("roles"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("appearances"), "person")))


@query(f"""+ {ALL_EVENTS}, n AS (SELECT 'person' AS kind, person AS name, count(*) AS n FROM evs WHERE person IS NOT NULL GROUP BY ALL UNION ALL SELECT 'asset', topic, count(*) FROM ev GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name)::INTEGER AS place FROM n) WHERE place <= 15""")
def home_tops(d: Domain) -> DataFrame:
    """The home page's people and assets with most opinions."""
    n = lambda df, kind, c: df.filter(F.col(c).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    both = n(all_events(d), "person", "person").unionByName(n(events(d), "asset", "topic"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))).filter("place <= 15")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'person-' || lpad((row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey))::VARCHAR, greatest(3, length((row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey))::VARCHAR))::INTEGER, '0') ELSE lower(replace(c_name, '#', '')) END AS slug FROM customer", prelude=False)
def person_pages(d: Domain) -> DataFrame:
    """Names of people's pages; those that leave no Latin letter are numbered in order."""
    name = F.when(F.col("c_custkey") % 3 == 0, "零一二").otherwise(F.col("c_name"))
    return op.person_slugs(d.table("customer").select(F.col("c_custkey").alias("id"), name.alias("person")), order="id").select("id", "slug")
