"""Cleaning, paths, topic matching, tracks and compatible runs over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.functions import clean
from callmark.operators import fuzzy
from callmark.plans.registry import query
from callmark.sources.domain import Domain


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'ch-' || c_custkey WHEN c_custkey % 3 = 1 THEN 'customer' || right(c_name, 9) ELSE lower(c_mktsegment) END AS slug, CASE WHEN c_custkey % 7 < 6 THEN right(c_name, 9) END AS vanity FROM customer", prelude=False)
def channel_names(d: Domain) -> DataFrame:
    """Slugs with their fall-backs, and names from handles and addresses."""
    k = F.col("c_custkey")
    handle, name = F.when(k % 3 == 1, F.concat(F.lit("@"), "c_name")), F.when(k % 3 == 2, F.col("c_mktsegment")).otherwise(F.lit("!!"))
    v = F.right("c_name", F.lit(9))
    around = (("https://example.com/c/", "/posts?x=1"), ("http://www.example.com/x?u=3&Vanity=", "&y=2"), ("/cw/", ""), ("user/", "/about"), (" @", ""), ("https://example.com/", "#top"))
    raw = F.element_at(F.array(*(F.concat(F.lit(a), v, F.lit(b)) for a, b in around), F.lit("https://example.com/user?u=12")), (k % 7 + 1).cast("int"))
    return d.table("customer").select(k.alias("id"), clean.channel_slug(handle, name, k).alias("slug"), clean.vanity(raw).alias("vanity"))


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS dated, 'Outlook' AS title, 'body' AS body FROM orders", prelude=False)
def cleaned_posts(d: Domain) -> DataFrame:
    """Dates in four forms, titles without their tails, bodies without calls to action and disclaimers."""
    k, on = F.col("o_orderkey"), F.col("o_orderdate")
    show = lambda f: F.date_format(on, f)
    text = F.when(k % 4 == 0, show("MM/dd/yyyy")).when(k % 4 == 1, show("MMMM d, yyyy")).when(k % 4 == 2, F.concat(F.lit("Created: "), show("d MMMM yyyy"))).otherwise(show("yyyy/MM/dd"))
    title = F.concat(F.lit("Outlook"), F.when(k % 2 == 0, " - Q3 2024").otherwise(" | March 5, 2024 (Q1 2024)"))
    body = F.concat(F.lit("body"), F.when(k % 2 == 0, "\nPlease subscribe now!\nmore").otherwise("\n**Disclaimer** this and that\nmore"))
    return d.table("orders").select(k.alias("id"), clean.free_date(text).alias("dated"), clean.clean_title(title).alias("title"), clean.strip_boilerplate(body).alias("body"))


@query("SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 5 = 0 THEN 'undated/' ELSE '2024/2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '-' END || 'title-' || doc_id || '.md' AS path FROM documents", prelude=False)
def content_paths(d: Domain) -> DataFrame:
    day = F.when(F.col("doc_id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")))
    return d.table("documents").select("doc_id", clean.content_path(F.col("source"), F.col("lang"), day, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("path"))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id % 5 <> 0 AND doc_id % 28 BETWEEN 4 AND 19", prelude=False)
def public_subset(d: Domain) -> DataFrame:
    return content_paths_frame(d).filter(clean.in_public_subset(F.col("path"), ["en", "de"], "2024-01-05", "2024-01-20")).select("doc_id")


def content_paths_frame(d: Domain) -> DataFrame:
    day = F.when(F.col("doc_id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")))
    return d.table("documents").select("doc_id", clean.content_path(F.col("source"), F.col("lang"), day, F.lit("t")).alias("path"))


_ASKED = """a AS (SELECT DISTINCT p_name AS topic, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS k FROM part),
b AS (SELECT asked, regexp_replace(lower(asked), '[^a-z0-9]+', '', 'g') AS q FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN string_split(p_name, ' ')[2] WHEN 1 THEN upper(replace(p_name, ' ', '-')) WHEN 2 THEN p_name || ' market analysis' ELSE right(p_name, 3) END AS asked FROM part))"""


@query(f"WITH {_ASKED}, m AS (SELECT asked, topic, q = k AS exact FROM b JOIN a ON q <> '' AND (contains(k, q) OR contains(q, k))) SELECT asked, topic FROM m WHERE exact OR asked NOT IN (SELECT asked FROM m WHERE exact)", prelude=False)
def topic_matches(d: Domain) -> DataFrame:
    """Topics for names that were asked for: that of the same normalised key, else those of which one's key holds the other's."""
    names = d.table("part").select(F.col("p_name").alias("topic")).distinct()
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    asked = F.when(k == 0, F.split(name, " ")[1]).when(k == 1, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).when(k == 2, F.concat(name, F.lit(" market analysis"))).otherwise(F.right(name, F.lit(3)))
    return fuzzy.contained(d.table("part").select(asked.alias("asked")).distinct(), "asked", names, "topic")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE lang WHEN 'zh' THEN 0 WHEN 'en' THEN 1 WHEN 'en-orig' THEN 1 ELSE 2 END, lang) AS rn FROM (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN 'zh' ELSE 'de' END AS lang FROM conversations)) SELECT conv_id, lang FROM r WHERE rn = 1", prelude=False)
def best_track(d: Domain) -> DataFrame:
    """The subtitle track of the most wanted language."""
    lang = F.element_at(F.array(*map(F.lit, ("fr", "en", "zh", "de"))), (F.col("turn") % 4 + 1).cast("int"))
    place = F.when(F.col("lang") == "zh", 0).when(F.col("lang").startswith("en"), 1).otherwise(2)
    return d.table("conversations").select("conv_id", lang.alias("lang")).groupBy("conv_id").agg(F.min_by("lang", F.struct(place.alias("p"), F.col("lang"))).alias("lang"))


_RUNS = "p AS (SELECT user_id, event_type AS run, min(event_id) % 13 AS mark, count(*) AS n FROM events GROUP BY ALL)"


@query(f"WITH {_RUNS} SELECT a.user_id, a.run FROM p a WHERE a.mark = (SELECT b.mark FROM p b WHERE b.user_id = a.user_id AND b.run = 'click')", prelude=False)
def compatible_runs(d: Domain) -> DataFrame:
    """Runs whose first page has the fingerprint of a given run's."""
    p = d.table("events").groupBy("user_id", F.col("event_type").alias("run")).agg((F.min("event_id") % 13).alias("mark"))
    return p.join(p.filter("run = 'click'").select("user_id", "mark"), ["user_id", "mark"], "left_semi").select("user_id", "run")


@query("SELECT 'v' || o_orderkey AS version, o_orderkey::INTEGER AS number FROM orders", prelude=False)
def versions(d: Domain) -> DataFrame:
    """All versions in natural order: v2 before v10. A range sort."""
    rows = d.table("orders").select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"))
    return rows.select("version", clean.version_key(F.col("version"))["number"].alias("number")).orderBy("number", "version")


@query("SELECT o_custkey AS owner, 'v' || o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders", prelude=False)
def owner_versions(d: Domain) -> DataFrame:
    """Natural order within each owner's versions, a row for each order."""
    from pyspark.sql import Window

    rows = d.table("orders").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(clean.version_key(F.col("version")))).cast("long"))


@query("SELECT doc_id, instr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(substring(text, 21, 80), '\\s+', ' ', 'g')))) AS place FROM documents", prelude=False)
def quote_places(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.coalesce(clean.quote_at(F.col("text"), F.substring("text", 21, 80)), F.lit(0)).cast("long").alias("place"))
