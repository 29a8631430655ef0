"""Audits, set operations and duplicates over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.operators import audit, fuzzy
from callmark.plans.registry import query
from callmark.sources import markdown as md
from callmark.sources.domain import Domain


_SIDES = """a AS (SELECT doc_id AS id, source, n_chars FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 13 = 5),
b AS (SELECT CASE WHEN doc_id % 17 = 2 THEN NULL ELSE doc_id - CASE WHEN doc_id % 19 = 1 THEN 1 ELSE 0 END END AS id, source, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0)"""


@query(f"""WITH {_SIDES}, x AS (SELECT id, min(source) AS source, min(n_chars) AS n_chars, count(*) - 1 AS more FROM a GROUP BY id), y AS (SELECT id, min(source) AS source, min(n_chars) AS n_chars, count(*) - 1 AS more FROM b WHERE id IS NOT NULL GROUP BY id),
j AS (SELECT coalesce(x.source, y.source) AS source, count(*) FILTER (WHERE y.id IS NULL) AS missing, count(*) FILTER (WHERE x.id IS NULL) AS orphans, count(*) FILTER (WHERE x.n_chars <> y.n_chars) AS mismatches, count(*) FILTER (WHERE x.n_chars = y.n_chars) AS fine, sum(coalesce(x.more, 0))::BIGINT AS repeated_rows, sum(coalesce(y.more, 0))::BIGINT AS repeated_files FROM x FULL JOIN y ON x.id = y.id GROUP BY ALL),
u AS (SELECT source, count(*) AS unreadable FROM b WHERE id IS NULL GROUP BY source) SELECT source, coalesce(missing, 0) AS missing, coalesce(orphans, 0) AS orphans, coalesce(mismatches, 0) AS mismatches, coalesce(fine, 0) AS fine, coalesce(repeated_rows, 0) AS repeated_rows, coalesce(repeated_files, 0) AS repeated_files, coalesce(unreadable, 0) AS unreadable FROM j FULL JOIN u USING (source)""", prelude=False)
def consistency(d: Domain) -> DataFrame:
    """What the table has against what the disk has, by source: the table lacks some documents and has others twice; of the files some
    have the number of the one before, and some no number that can be read."""
    docs, n = d.table("documents"), F.col("doc_id")
    row = lambda key, chars: (key.alias("key"), "source", chars.alias("content"))
    table = docs.filter(n % 7 != 0).unionByName(docs.filter(n % 13 == 5)).select(*row(n, F.col("n_chars")))
    key = F.when(n % 17 != 2, n - F.when(n % 19 == 1, 1).otherwise(0))
    files = docs.filter(n % 5 != 0).select(*row(key, F.when(n % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))))
    return audit.compared(table, files)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES), prelude=False)
def row_counts(d: Domain) -> DataFrame:
    from functools import reduce

    counts = [d.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES]
    return reduce(DataFrame.unionByName, counts)


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(text, 'the ')) AS with_mark, round(100.0 * count(*) FILTER (WHERE NOT contains(text, 'the ')) / count(*), 6) AS missing_pct FROM documents GROUP BY source", prelude=False)
def transcript_coverage(d: Domain) -> DataFrame:
    has = F.col("text").contains("the ")
    return d.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("with_mark"), F.round(100.0 * F.count_if(~has) / F.count(F.lit(1)), 6).alias("missing_pct"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 - doc_id END AS id FROM documents UNION SELECT page_id FROM pages EXCEPT SELECT doc_id FROM labels WHERE toxic = 1", prelude=False)
def set_algebra(d: Domain) -> DataFrame:
    """Distinct union, less what is gone; odd documents have ids that no page has."""
    ids = d.table("documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("id"))
    both = ids.union(d.table("pages").select("page_id")).distinct()
    return both.join(d.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("SELECT doc_id AS path, sha256(text) AS digest FROM documents WHERE doc_id % 3 = 0 AND (doc_id % 2 = 1 OR doc_id % 4 = 0)", prelude=False)
def changed_pages(d: Domain) -> DataFrame:
    """Pages that are to be written, for the manifest has none of that content."""
    docs = d.table("documents").select(F.col("doc_id").alias("path"), "text")
    new = docs.filter("path % 3 = 0")
    old = docs.filter("path % 2 = 0").withColumn("text", F.when(F.col("path") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return md.changed(new, old)[0].select("path", F.sha2("text", 256).alias("digest"))


@query("SELECT path FROM (SELECT doc_id AS path FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 = 0)", prelude=False)
def stale_pages(d: Domain) -> DataFrame:
    docs = d.table("documents").select(F.col("doc_id").alias("path"), "text")
    return md.changed(docs.filter("path % 3 = 0"), docs.filter("path % 2 = 0"))[1]


def _stem_sql(table: str, key: str, stem: str) -> str:
    return f"SELECT {key}, {stem} AS stem, list_distinct(regexp_extract_all({stem}, '[a-z]{{4,}}')) AS t FROM (SELECT *, regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g') AS slug FROM {table})"


@query(f"""WITH a AS ({_stem_sql("benchmark", "item_id", "slug")}), b AS ({_stem_sql("documents", "doc_id", "'2024-01-01-mv-' || doc_id % 97 || '-' || left(slug, 60)")}),
m AS (SELECT item_id, doc_id, length(a.stem) > 0 AND contains(b.stem, left(a.stem, 24)) AS by_prefix, contains(b.stem, 'mv-' || item_id) AS by_number, len(list_intersect(a.t, b.t)) AS shared FROM a, b)
SELECT item_id, doc_id, by_prefix, by_number, shared >= 3 AS by_tokens FROM m WHERE by_prefix OR by_number OR shared >= 3""", prelude=False)
def fuzzy_matches(d: Domain) -> DataFrame:
    """Stems of files that hold the first 24 characters of a title's slug or its number, or share at least three words of four letters or more."""
    slug = F.regexp_replace(F.lower(F.split("text", "\n")[0]), "[^a-z0-9]+", "-")
    wanted = d.table("benchmark").select("item_id", slug.alias("slug"), F.col("item_id").cast("string").alias("number"))
    stem = F.concat(F.lit("2024-01-01-mv-"), (F.col("doc_id") % 97).cast("string"), F.lit("-"), F.left(slug, F.lit(60)))
    return fuzzy.same_title(wanted, d.table("documents").select("doc_id", stem.alias("stem")), "item_id", "doc_id")


@query("SELECT event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS facet, count(*) AS n FROM events GROUP BY ALL", prelude=False)
def facets(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("facet")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2024-01-01') AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", prelude=False)
def weekly_windows(d: Domain) -> DataFrame:
    """Tumbling weeks from a Monday on; callmark.streaming runs the same over a stream."""
    from callmark.streaming.weekly import weekly

    return weekly(d.table("events")).select("user_id", "week", "n", F.round("total", 4).alias("total"))
