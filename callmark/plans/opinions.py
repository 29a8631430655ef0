"""Opinions over time: topics, persons, themes, flips, disagreements, timelines, pages' data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls, themes
from callmark.operators import opinions as op
from callmark.plans.registry import query
from callmark.session import materialise
from callmark.sources.domain import Domain

#: So many tasks may share the calls of a channel on a topic.
SHARES = 16
ALIASES = {"s1": "S One", "s2": "S Two"}
#: The table of themes, and four that the parts' names have.
PART_THEMES = themes.THEMES | {"metal": ["bolt", "gear", "ring"], "color red": ["red "], "large": ["large", "big"], "promo": ["promo"]}


def theme_sql(of: str, themes: dict[str, list[str]], select: str) -> str:
    """One SELECT a theme of the rows in whose column low one of its keywords stands."""
    return " UNION ALL ".join(f"SELECT {select.format(theme=name)} FROM {of} WHERE regexp_matches(low, '{op.keyword_pattern(words)}')" for name, words in themes.items()).replace("\\ ", " ")


PERSON = "CASE WHEN call.speaker = 'S3' OR call.speaker = '' THEN NULL WHEN call.speaker = 'S1' THEN 'S One' WHEN call.speaker = 'S2' THEN 'S Two' ELSE call.speaker END"
EVENTS = f"ev AS (SELECT call_id AS ref, item_id, {PERSON} AS person, ticker AS topic, sign AS stance, made_at AS seen_at, kind, asset_name FROM call)"


def events(d: Domain) -> DataFrame:
    person = op.resolve_person(F.col("speaker"), ALIASES, generic=("s3",))
    return d.call.select(F.col("call_id").alias("ref"), "item_id", person.alias("person"), calls.topic_key(F.col("ticker"), F.col("asset_name")).alias("topic"), calls.stance(F.col("direction"), F.col("action")).alias("stance"), F.col("made_at").alias("seen_at"), "kind", "asset_name")


# Brand#9 has a character that tickers do not allow, so topics are names there: the projection asks for that
_TOPIC = "CASE WHEN regexp_full_match(upper(trim(ticker)), '[A-Z0-9^.=:\\-]{1,12}(\\.[A-Z]{1,4})?') THEN upper(trim(ticker)) ELSE coalesce(nullif(trim(asset_name), ''), ticker) END"
EVENTS = EVENTS.replace("ticker AS topic", f"{_TOPIC} AS topic")


@query(f"+ {EVENTS}, sided AS (SELECT *, lag(stance) OVER w AS prev_stance, lag(seen_at) OVER w AS prev_at FROM ev WHERE stance <> 0 AND person IS NOT NULL WINDOW w AS (PARTITION BY person, topic ORDER BY seen_at, ref)) SELECT person, topic, ref, stance, seen_at, prev_at FROM sided WHERE prev_stance = -stance AND seen_at > prev_at")
def opinion_shifts(d: Domain) -> DataFrame:
    return op.flips(events(d).filter("person IS NOT NULL"), ["person", "topic"]).select("person", "topic", "ref", "stance", "seen_at", "prev_at").orderBy(F.desc("seen_at"), "ref")


@query(f"+ {EVENTS} SELECT person, topic, coalesce(arg_max(stance, (seen_at, ref)) FILTER (WHERE stance <> 0), arg_max(stance, (seen_at, ref))) AS stance, count(*) AS n, max(seen_at) AS last_at FROM ev WHERE person IS NOT NULL GROUP BY ALL")
def person_topics(d: Domain) -> DataFrame:
    rows = events(d).filter("person IS NOT NULL")
    return op.current_stance(rows, ["person", "topic"], n=F.count(F.lit(1)), last_at=F.max("seen_at")).drop("seen_at")


@query(f"+ {EVENTS}, latest AS (SELECT topic, person, arg_max(stance, (seen_at, ref)) FILTER (WHERE stance <> 0) AS stance FROM ev WHERE person IS NOT NULL GROUP BY ALL) SELECT topic, count(*) FILTER (WHERE stance = 1) AS n_bulls, count(*) FILTER (WHERE stance = -1) AS n_bears FROM latest GROUP BY topic HAVING n_bulls > 0 AND n_bears > 0")
def disagreement(d: Domain) -> DataFrame:
    latest = op.current_stance(events(d).filter("person IS NOT NULL"), ["topic", "person"], fall_back=False)
    return op.disagreements(latest).orderBy(F.desc(F.col("n_bulls") + F.col("n_bears")), "topic")


@query(f"""+ {EVENTS}, mine AS (SELECT person, topic, coalesce(arg_max(stance, (seen_at, ref)) FILTER (WHERE stance <> 0), arg_max(stance, (seen_at, ref))) AS stance, arg_max(stance, (seen_at, ref)) AS last FROM ev WHERE person IS NOT NULL GROUP BY ALL),
sides AS (SELECT topic, count(*) FILTER (WHERE last = 1) AS up, count(*) FILTER (WHERE last = -1) AS down FROM mine GROUP BY topic)
SELECT person, topic, stance, CASE WHEN stance = 1 THEN down ELSE up END AS n_opposed FROM mine JOIN sides USING (topic) WHERE stance <> 0""")
def opposed_people(d: Domain) -> DataFrame:
    """How many others stand against a person's current stance with their last event; counted by side, not by pairs of people. Stances are found once and read for both."""
    by = ["person", "topic"]
    rows = materialise(op.current_stance(events(d).filter("person IS NOT NULL"), by, last=F.max_by("stance", F.struct("seen_at", "ref"))))
    sides = rows.groupBy("topic").agg(F.count_if(F.col("last") == 1).alias("up"), F.count_if(F.col("last") == -1).alias("down"))
    mine = rows.filter("stance <> 0").join(sides, "topic")
    return mine.select(*by, "stance", F.when(F.col("stance") == 1, F.col("down")).otherwise(F.col("up")).alias("n_opposed"))


@query(f"""+ {EVENTS}, r AS (SELECT ev.*, channel_id, source_id, count(DISTINCT person) OVER (PARTITION BY item_id) AS n_people FROM ev JOIN item USING (item_id) WHERE person IS NOT NULL)
SELECT person, count(*) AS n_events, count(DISTINCT item_id) AS appearances, count(DISTINCT channel_id) AS n_channels, string_agg(DISTINCT CASE WHEN source_id = 1 THEN 'host' WHEN n_people > 1 THEN 'guest' ELSE 'solo' END, '/' ORDER BY CASE WHEN source_id = 1 THEN 'host' WHEN n_people > 1 THEN 'guest' ELSE 'solo' END) AS roles FROM r GROUP BY person""".replace("count(DISTINCT person) OVER (PARTITION BY item_id)", "n_people").replace("FROM ev JOIN item USING (item_id)", "FROM ev JOIN item USING (item_id) JOIN (SELECT item_id, count(DISTINCT person) AS n_people FROM ev GROUP BY item_id) USING (item_id)").replace("source_id, n_people AS n_people", "source_id, n_people"))
def people(d: Domain) -> DataFrame:
    """Persons with events, items, channels and roles; a person hosts where the item's source is theirs."""
    by_item = events(d).filter("person IS NOT NULL").groupBy("item_id", "person").agg(F.count(F.lit(1)).alias("n"))
    counted = by_item.withColumn("n_people", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).join(d.item.select("item_id", "channel_id", "source_id"), "item_id")
    named = counted.withColumn("role", op.role(F.col("source_id") == 1, F.col("n_people")))
    return named.groupBy("person").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("appearances"), F.countDistinct("channel_id").alias("n_channels"), F.array_join(F.sort_array(F.collect_set("role")), "/").alias("roles"))


@query(f"""+ {EVENTS}, lone AS (SELECT item_id, min(person) AS p FROM ev GROUP BY item_id HAVING min(person) = max(person)) SELECT ref, coalesce(person, p) AS person FROM ev LEFT JOIN lone USING (item_id)""")
def attributed_speakers(d: Domain) -> DataFrame:
    return op.attributed(events(d).select("ref", "item_id", "person")).select("ref", "person")


@query(f"""+ {EVENTS} SELECT topic, count(*) AS n_calls, count(*) FILTER (WHERE stance = 1) AS bulls, count(*) FILTER (WHERE stance = -1) AS bears,
CASE WHEN count(*) FILTER (WHERE stance = 1) > count(*) FILTER (WHERE stance = -1) THEN 'bullish' WHEN count(*) FILTER (WHERE stance = 1) < count(*) FILTER (WHERE stance = -1) THEN 'bearish' WHEN count(*) FILTER (WHERE stance = 1) > 0 THEN 'mixed (conflict)' ELSE 'neutral / watch' END AS consensus,
array_to_string(list_sort(list_distinct(list(person))), ',') AS people, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM ev JOIN item USING (item_id) JOIN source USING (source_id) GROUP BY topic""")
def ticker_page(d: Domain) -> DataFrame:
    bulls, bears = (F.count_if(F.col("stance") == s) for s in (1, -1))
    rows = events(d).join(d.item.select("item_id", "source_id"), "item_id").join(F.broadcast(d.source), "source_id")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n_calls"), bulls.alias("bulls"), bears.alias("bears"), calls.ticker_consensus(bulls, bears).alias("consensus"), names("person").alias("people"), names("source").alias("sources"))


@query(f"""+ {EVENTS}, s AS (SELECT topic, person, count(*) AS n, max(seen_at) AS last_at FROM ev WHERE person IS NOT NULL GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, last_at DESC, person)::INTEGER AS place FROM s),
r AS (SELECT ev.topic, ev.person, place, ref, seen_at, row_number() OVER (PARTITION BY ev.topic, ev.person ORDER BY seen_at DESC, ref DESC) AS rn FROM ev JOIN top ON ev.topic = top.topic AND ev.person = top.person WHERE place <= 8) SELECT topic, person, place, ref, seen_at FROM r WHERE rn <= 4""")
def top_voices(d: Domain) -> DataFrame:
    """Eight people with most calls for each topic, four newest calls of each."""
    rows = events(d).filter("person IS NOT NULL").select("topic", "person", "ref", "seen_at")
    newest = Window.partitionBy("topic", "person").orderBy(F.desc("seen_at"), F.desc("ref"))
    counted = rows.withColumns({"rn": F.row_number().over(newest), "n": F.count(F.lit(1)).over(Window.partitionBy("topic", "person")), "last_at": F.max("seen_at").over(Window.partitionBy("topic", "person"))}).filter("rn <= 4")
    return counted.withColumn("place", F.dense_rank().over(Window.partitionBy("topic").orderBy(F.desc("n"), F.desc("last_at"), "person"))).filter("place <= 8").select("topic", "person", "place", "ref", "seen_at")


@query(f"""+ {EVENTS}, n AS (SELECT channel_id, topic, count(*) AS n, count(*) FILTER (WHERE stance = 1) AS bulls, count(*) FILTER (WHERE stance = -1) AS bears FROM ev JOIN item USING (item_id) WHERE channel_id IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, topic)::INTEGER AS place FROM n) WHERE place <= 10""")
def analyst_page(d: Domain) -> DataFrame:
    """A channel's ten topics of most calls, with its stance mix. Each shuffle goes to as many tasks as there are calls for; calls are summed by item, by some items of a
    channel and by channel, so that a channel with many is not one task's."""
    tasks = d.tasks("lineitem")
    count = lambda s: F.count_if(F.col("stance") == s)
    total = lambda rows, *by: rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "bulls", "bears")))
    by_item = events(d).select("item_id", "topic", "stance").repartition(tasks, "item_id").groupBy("item_id", "topic").agg(F.count(F.lit(1)).alias("n"), count(1).alias("bulls"), count(-1).alias("bears"))
    owned = by_item.join(d.item.filter("channel_id IS NOT NULL").select("item_id", "channel_id").repartition(tasks, "item_id"), "item_id")
    share = owned.withColumn("share", F.pmod(F.xxhash64("item_id"), F.lit(SHARES))).repartition(tasks, "channel_id", "topic", "share")
    n = total(total(share, "channel_id", "topic", "share").repartition(tasks, "channel_id"), "channel_id", "topic")
    return n.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "topic"))).filter("place <= 10")


_THEMES = theme_sql("t", PART_THEMES, "ref, '{theme}' AS theme")


def tagged(d: Domain) -> DataFrame:
    text = F.concat_ws(" ", "kind", "asset_name")
    return events(d).withColumn("theme", F.explode(op.themes_of(text, PART_THEMES)))


@query(f"""+ {EVENTS}, t AS (SELECT ref, lower(kind || ' ' || asset_name) AS low FROM ev), tag AS ({_THEMES}), n AS (SELECT theme, topic, count(*) AS n, count(DISTINCT person) AS n_people FROM tag JOIN ev USING (ref) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY n DESC, topic)::INTEGER AS place FROM n) WHERE place <= 10""".replace("\\ ", " "))
def theme_page(d: Domain) -> DataFrame:
    """Themes' ten topics of most calls; a call may have several themes, one without any vanishes."""
    n = tagged(d).groupBy("theme", "topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person").alias("n_people"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("n"), "topic"))).filter("place <= 10")


@query(f"+ {EVENTS} SELECT year(seen_at) AS year, count(*) AS n_calls, count(DISTINCT topic) AS n_topics, count(DISTINCT person) AS n_people, count(*) FILTER (WHERE stance = 1) AS bulls, count(*) FILTER (WHERE stance = -1) AS bears FROM ev GROUP BY year(seen_at)")
def timeline(d: Domain) -> DataFrame:
    return events(d).groupBy(F.year("seen_at").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("topic").alias("n_topics"), F.countDistinct("person").alias("n_people"), F.count_if(F.col("stance") == 1).alias("bulls"), F.count_if(F.col("stance") == -1).alias("bears"))


@query(f"+ {EVENTS} SELECT topic, ref, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY seen_at DESC, ref DESC) AS rn FROM ev WHERE regexp_matches(lower(asset_name), '\\bblue\\b') AND NOT topic LIKE '%bolt') WHERE rn <= 6")
def backdrop(d: Domain) -> DataFrame:
    """The six newest events on a keyword for each topic, but for topics that are the keyword's own."""
    rows = events(d).filter(F.lower("asset_name").rlike(op.keyword_pattern(["blue"])) & ~F.col("topic").like("%bolt"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("seen_at"), F.desc("ref")))).filter("rn <= 6").select("topic", "ref", "seen_at")


@query("""+ n AS (SELECT channel_id, item_id, published_at, row_number() OVER (PARTITION BY channel_id ORDER BY published_at, item_id) AS rn, count(*) OVER (PARTITION BY channel_id) AS total FROM item WHERE channel_id IS NOT NULL)
SELECT channel_id, item_id, published_at FROM n WHERE ((rn - 1) % greatest(1, total // 5) = 0 AND (rn - 1) // greatest(1, total // 5) < 5) OR rn = total""")
def study_sample(d: Domain) -> DataFrame:
    """Five items of each channel, spread over time, and its last one."""
    w = Window.partitionBy("channel_id").orderBy("published_at", "item_id")
    rows = d.item.filter("channel_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("channel_id")))
    step = F.greatest(F.lit(1), F.expr("total DIV 5"))
    return rows.filter((((F.col("rn") - 1) % step == 0) & (F.floor((F.col("rn") - 1) / step) < 5)) | (F.col("rn") == F.col("total"))).select("channel_id", "item_id", "published_at")


@query("SELECT (SELECT count(*) FROM item) AS n_items, (SELECT count(DISTINCT channel_id) FROM item) AS n_channels, (SELECT count(*) FROM call) AS n_calls, (SELECT count(DISTINCT ticker) FROM call) AS n_tickers, (SELECT count(DISTINCT speaker) FROM call) AS n_speakers, (SELECT min(published_at) FROM item) AS first_at, (SELECT max(published_at) FROM item) AS last_at, (SELECT round(100.0 * count(*) FILTER (WHERE status = 'done') / greatest(count(*), 1), 6) FROM item) AS coverage")
def home_totals(d: Domain) -> DataFrame:
    a = d.item.agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("channel_id").alias("n_channels"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"), F.round(100.0 * F.count_if(F.col("status") == "done") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("coverage"))
    b = d.call.agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("speaker").alias("n_speakers"))
    return a.join(F.broadcast(b))  # one row each


@query("SELECT coalesce(CASE WHEN lang <> 'es' THEN lang END, '(unknown)') AS language, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, language LIMIT 8", prelude=False)
def top_languages(d: Domain) -> DataFrame:
    lang = F.when(F.col("lang") != "es", F.col("lang"))
    return d.table("documents").groupBy(F.coalesce(lang, F.lit("(unknown)")).alias("language")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").limit(8)


@query("""+ n AS (SELECT channel_id, count(DISTINCT item_id) AS n_extracted, count(DISTINCT item_id) FILTER (WHERE item_id IN (SELECT item_id FROM primary_call WHERE sign <> 0)) AS n_with_calls FROM item WHERE status = 'done' AND channel_id IS NOT NULL GROUP BY channel_id) SELECT * FROM n WHERE n_extracted > 0""")
def extracted_channels(d: Domain) -> DataFrame:
    has = d.primary_call.filter(calls.stance(F.col("direction"), F.col("action")) != 0).select("item_id", F.lit(1).alias("has")).distinct()
    rows = d.item.filter("status = 'done' AND channel_id IS NOT NULL").join(has, "item_id", "left")
    return rows.groupBy("channel_id").agg(F.countDistinct("item_id").alias("n_extracted"), F.countDistinct(F.when(F.col("has") == 1, F.col("item_id"))).alias("n_with_calls"))
