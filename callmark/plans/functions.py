"""Functions of text, JSON and calls over whole tables, on values made from them; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.functions import calls, clean
from callmark.functions import text as tx
from callmark.functions import variants as va
from callmark.plans.registry import query
from callmark.sources.domain import Domain


def picked(n, *forms):
    """The form of each row, by its number."""
    return F.element_at(F.array(*(x if not isinstance(x, str) else F.lit(x) for x in forms)), (n % len(forms) + 1).cast("int"))


@query("SELECT user_id, 'c' || arg_min(event_type, event_id) AS label FROM events WHERE event_id % 4 >= 2 GROUP BY user_id", prelude=False)
def first_labels(d: Domain) -> DataFrame:
    n, t = F.col("event_id"), F.col("event_type")
    line = picked(n, F.lit("broken"), F.lit('{"uploader": "  "}'), F.concat(F.lit('{"channel": "c'), t, F.lit('"}')), F.concat(F.lit('{"uploader": "c'), t, F.lit('", "channel": "x"}')))
    return clean.first_label(d.table("events").select("user_id", "event_id", line.alias("line")), "line", "event_id", ("user_id",))


_OBJECT = """'{"id": ' || doc_id || ', "q": "a \\" } b {", "n": {"k": [{}, {"s": "' || source || '"}]}}'"""


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN {_OBJECT} END AS object, CASE WHEN doc_id % 3 = 0 THEN {_OBJECT} WHEN doc_id % 3 = 1 THEN '{{\"a\": ' || doc_id || '}}' END AS answer FROM documents", prelude=False)
def embedded_json(d: Domain) -> DataFrame:
    """Objects found again in scripts, after a marker, and in a model's answers, fenced or within prose; what never closes gives none."""
    n = F.col("doc_id")
    made = F.concat(F.lit('{"id": '), n.cast("string"), F.lit(', "q": "a \\" } b {", "n": {"k": [{}, {"s": "'), "source", F.lit('"}]}}'))
    script = picked(n, F.concat(F.lit("var other = {}; var data = "), made, F.lit("; run({});")), F.concat(F.lit('var data = call("}") '), made), F.concat(F.lit("x var data ="), made, F.lit("}")), F.concat(F.lit('var data = {"open": "'), "source"))
    answer = picked(n, F.concat(F.lit("Sure: "), made, F.lit(" done.")), F.concat(F.lit('```json\n{"a": '), n.cast("string"), F.lit("}\n```")), F.lit("garbage {"))
    return d.table("documents").select("doc_id", tx.json_after(script, "var data").alias("object"), tx.loose_json(answer).alias("answer"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS side FROM events", prelude=False)
def view_stances(d: Domain) -> DataFrame:
    return d.table("events").select("event_id", calls.view_stance(picked(F.col("event_id"), "Bullish ", "BEARISH", "mixed", F.lit(None).cast("string"))).alias("side"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 'A.B' WHEN 2 THEN NULL END AS ticker, CASE p_partkey % 4 WHEN 2 THEN 'Pan Mine' || p_partkey WHEN 3 THEN NULL ELSE p_name END AS name FROM part", prelude=False)
def ticker_hygiene(d: Domain) -> DataFrame:
    """Symbols upper-cased; what is none becomes the name, where that is blank."""
    n, name = F.col("p_partkey"), F.col("p_name")
    raw = picked(n, F.concat(F.lit(" t"), n.cast("string"), F.lit(" ")), F.lit("a.b"), F.concat(F.lit("PAN MINE"), n.cast("string")), F.lit(None).cast("string"))
    known = picked(n, name, name, F.lit("  "), F.lit(None).cast("string"))
    return d.table("part").select(n.alias("id"), calls.ticker(raw).alias("ticker"), calls.asset_name(raw, known).alias("name"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'untitled' ELSE 'a-b.' || doc_id || '_' || source END AS slug, CASE doc_id % 3 WHEN 0 THEN 'n/d' WHEN 1 THEN '2024-03-0' || (doc_id % 9 + 1) ELSE 'not a date' END AS shown,
CASE doc_id % 3 WHEN 2 THEN NULL ELSE TIMESTAMP '2024-03-01 10:00:00' + to_seconds(doc_id % 60) END AS at, CASE doc_id % 3 WHEN 0 THEN '20220515' WHEN 1 THEN '2020010' || (doc_id % 9 + 1) END AS uploaded, left(sha256(source), 16) AS digest FROM documents""", prelude=False)
def date_forms(d: Domain) -> DataFrame:
    """Names of pages, dates as shown, ISO times, upload dates within HTML, and short digests."""
    n = F.col("doc_id")
    title = picked(n, F.lit("漢字 --"), *[F.concat(F.lit(" A /\\ b."), n.cast("string"), F.lit("_"), "source", F.lit("-"))] * 2)
    shown = picked(n, F.lit(None).cast("string"), F.concat(F.lit("2024-03-0"), (n % 9 + 1).cast("string"), F.lit("T10:00:00Z")), F.lit("not a date at all"))
    at = picked(n, *[F.concat(F.lit(f"2024-03-01T{hour}:00:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(zone)) for hour, zone in ((10, "Z"), (12, "+02:00"))], F.lit("soon"))
    html = picked(n, '<x>{"publishDate":"2022-05-15T00:00","uploadDate":"2021-01-01"}', F.concat(F.lit('{"uploadDate" : "2020-01-0'), (n % 9 + 1).cast("string"), F.lit('"}')), '"uploadDate":"1987-02-30"')
    return d.table("documents").select("doc_id", tx.page_slug(title).alias("slug"), F.left(tx.show_date(shown), F.lit(10)).alias("shown"), tx.iso_timestamp(at).cast("timestamp_ntz").alias("at"), tx.upload_date(html, F.lit("2030-01-01").cast("date")).alias("uploaded"), tx.digest16(F.col("source")).alias("digest"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[#*…\\n]', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Real' || chr(10) || t WHEN 1 THEN t ELSE '# Own' || chr(10) || t END AS body, doc_id % 3 <> 1 AS has_transcript,
length(regexp_replace(t, '^ +| +$', '', 'g')) >= 400 AND NOT regexp_matches(regexp_replace(t, ' +$', '', 'g'), '\\.\\.\\.$') AND doc_id % 5 <> 4 AS is_full FROM t""", prelude=False)
def article_bodies(d: Domain) -> DataFrame:
    """Articles from their own heading on, whether they have a transcript, and whether they are whole."""
    n = F.col("doc_id")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[#*…\n]", " ")
    body = picked(n, F.concat(F.lit("banner\n# Opinion\nx\n# Real\n"), t), t, F.concat(F.lit("# Own\n"), t))
    marked = F.concat(t, picked(n, F.lit(""), F.lit("\n" + clean.NO_TRANSCRIPT), F.lit("")))
    shown = F.concat(F.lit("# Title\n* by line\n"), t, F.when(n % 5 == 4, clean.EXCERPT_MARK).otherwise(""))
    return d.table("documents").select("doc_id", clean.from_heading(body, ("opinion",)).alias("body"), clean.has_transcript(marked).alias("has_transcript"), clean.is_full(shown).alias("is_full"))


@query("SELECT o_orderkey AS id, '- **Duration:** ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || ' sec' ELSE '?' END || chr(10) || '- **Published:** 2024' || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || 'About $' || o_orderkey || ' in C:\\x \\1 ${n}' || chr(10) || chr(10) || '## Transcript' || chr(10) || 'text' AS body FROM orders", prelude=False)
def patched_pages(d: Domain) -> DataFrame:
    """Metadata with signs that patterns know merged into pages, twice, which changes nothing more."""
    n = F.col("o_orderkey")
    body = F.lit("- **Duration:** ?\n- **Published:** ?\n\n## Description\n\n\n## Transcript\ntext")
    patch = lambda b: clean.patch_metadata(b, F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(" sec"))), F.lit("2024"), F.concat(F.lit("About $"), n.cast("string"), F.lit(r" in C:\x \1 ${n}")))
    return d.table("orders").select(n.alias("id"), patch(patch(body)).alias("body"))


@query("SELECT doc_id, '[A](' || CASE doc_id % 3 WHEN 0 THEN source || '-x.md)' ELSE source || '_y.md)' END || ' and ' || CASE WHEN doc_id % 2 = 0 THEN 'gone' ELSE '[B](' || source || '_y.md)' END AS body FROM documents", prelude=False)
def linked_pages(d: Domain) -> DataFrame:
    """Links to pages that are known under the other mark, and labels in place of links to pages that are not."""
    docs, n = d.table("documents"), F.col("doc_id")
    pages = docs.select("source").distinct().select(F.explode(F.array(F.concat("source", F.lit("-x.md")), F.concat("source", F.lit("_y.md")))).alias("page"))
    first = picked(n, F.concat("source", F.lit("_x.md")), F.concat("source", F.lit("-y.md")), F.concat("source", F.lit("_y.md")))
    second = F.when(n % 2 == 0, F.concat(F.lit("[gone](none-"), "source", F.lit(".md)"))).otherwise(F.concat(F.lit("[B]("), "source", F.lit("_y.md)")))
    return clean.sanitise_links(docs.select("doc_id", F.concat(F.lit("[A]("), first, F.lit(") and "), second).alias("body")), pages, "doc_id", "body")


@query("SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'u' || page_id END AS id, CASE page_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'head' ELSE 'title' END AS title, CASE WHEN page_id % 4 < 3 THEN url END AS link FROM pages", prelude=False)
def asset_rows(d: Domain) -> DataFrame:
    """Stories, videos and outlinks in JSON as rows of one shape; other kinds give nulls."""
    n = F.col("page_id")
    kind = picked(n, "Story", "Video", "Outlink", "Advert")
    url = F.replace("url", F.lit('"'), F.lit(""))
    field = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    raw = picked(n, field('{"uuid": "u', n.cast("string"), '", "title": "title", "canonicalUrl": {"url": "', url, '"}}'), field('{"id": "u', n.cast("string"), '", "title": "title", "url": "', url, '"}'), field('{"id": "u', n.cast("string"), '", "headline": "head", "outlinkUrl": "', url, '"}'), "{}")
    asset = clean.asset_row(kind, raw)
    return d.table("pages").select("page_id", asset.alias("a")).select("page_id", "a.id", "a.title", F.col("a.url").alias("link"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 4 THEN 'x' || o_orderkey END AS external_id, CASE o_orderkey % 5 WHEN 0 THEN 'ha' || o_custkey WHEN 1 THEN 'sl' || o_custkey WHEN 2 THEN 'au' || o_custkey END AS channel_ref,
CASE WHEN o_orderkey % 5 < 2 THEN o_orderdate END AS published_at FROM orders""", prelude=False)
def descriptors(d: Domain) -> DataFrame:
    """Records of discovery, whatever their shape, with one id, channel and date; a record without an id gives nulls."""
    n, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    channel = picked(n, F.concat(F.lit('"channel_handle": " ha'), who, F.lit(' ", "author": {"slug": "no"}')), F.concat(F.lit('"channel_handle": "  ", "author": {"slug": "sl'), who, F.lit('"}')), F.concat(F.lit('"author": {"handle": "au'), who, F.lit('"}')), F.lit('"author": "text"'), F.lit('"channel_handle": "x"'))
    at = F.when(n % 5 < 2, F.concat(day, F.when(n % 2 == 0, "Z").otherwise(""))).otherwise(F.lit("soon"))
    raw = F.concat(F.lit('{"external_id": "'), F.when(n % 5 < 4, F.concat(F.lit(" x"), n.cast("string"))).otherwise("  "), F.lit('", "url": "u", '), channel, F.lit(', "published_at": "'), at, F.lit('"}'))
    return d.table("orders").select(n.alias("id"), tx.descriptor(raw).alias("r")).select("id", "r.external_id", "r.channel_ref", "r.published_at")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"seen":' || user_id || '}' WHEN 1 THEN '{"a":"1","seen":' || user_id || '}' WHEN 2 THEN '{"f":true,"n":null,"o":{"k":[1,"x"]},"seen":' || user_id || ',"z":2}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{"cut": ' ELSE '{"k":' || (props->>'k') || ',"seen":' || user_id || '}' END AS blob FROM events""", prelude=False)
def json_keys(d: Domain) -> DataFrame:
    """A key set in JSON objects that lack it, have it, have fields of all types, or are null; arrays and broken texts stay as they are."""
    blob = picked(F.col("event_id"), F.lit(None).cast("string"), '{"seen": "old", "a": "1"}', '{"z": 2, "o": {"k": [1, "x"]}, "f": true, "n": null}', "[1, 2]", '{"cut": ', F.col("props"))
    return d.table("events").select("event_id", va.set_key(blob, "seen", F.col("user_id")).alias("blob"))


@query("SELECT doc_id, i AS place, CASE i WHEN 0 THEN source ELSE 'oil' END AS topic, i = 0 AS recurring, CASE i WHEN 0 THEN 'n' || doc_id ELSE '' END AS new, CASE i WHEN 0 THEN 2 ELSE 0 END AS n_changes, CASE i WHEN 0 THEN 'q' || doc_id END AS quote, CASE i WHEN 0 THEN 1 ELSE 0 END AS n_tags FROM documents, range(0, 2) r(i)", prelude=False)
def topic_reports(d: Domain) -> DataFrame:
    """Topics with their changes and numbered tags, out of a model's lines."""
    n = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("noise\n TOPIC: "), "source", F.lit(" | RECURRING: yes | NEW: n"), n, F.lit('\nCHANGE: "q'), n, F.lit('" -> fell\nso\nchange: "x" -> rose\nTOPIC: oil | RECURRING: No | NEW:\nTOPIC: half'))
    tags = F.concat(F.lit("0 | gold; "), "source", F.lit("\n1 | ; \nnoise\n9 | late"))
    rows = d.table("documents").select("doc_id", F.posexplode(clean.topic_lines(raw)).alias("place", "t"), clean.numbered_tags(tags, F.lit(5)).alias("g"))
    n_tags = F.size(F.filter("g", lambda x: x["i"] == F.col("place")))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "t.topic", "t.recurring", "t.new", F.size("t.changes").alias("n_changes"), F.get("t.changes", F.lit(0))["quote"].alias("quote"), n_tags.alias("n_tags"))


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, b DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s""", prelude=False)
def user_sessions(d: Domain) -> DataFrame:
    """Sessions with gaps of half an hour; callmark.streaming has the same for streams (an extension)."""
    from callmark.streaming.weekly import sessions

    return sessions(d.table("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


_MICROS = "round(x::DOUBLE * 1e6)::BIGINT"


@query(f"SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CASE WHEN {_MICROS} < 0 THEN '-' ELSE '' END || (abs({_MICROS}) // 1000000) || '.' || lpad((abs({_MICROS}) % 1000000)::VARCHAR, 6, '0')), ',') || ']' AS shown FROM embeddings", prelude=False)
def vector_texts(d: Domain) -> DataFrame:
    """Vectors as text with six decimals, after those of a run were replaced as a whole."""
    from callmark.operators.incremental import replace_run

    e = d.table("embeddings").select("vec_id", "embedding")
    old = e.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 1)).otherwise(F.col("embedding")))
    return replace_run(old, e.filter("vec_id % 2 = 0"), "vec_id").select("vec_id", tx.vector_text(F.col("embedding")).alias("shown"))


@query("SELECT split_part(path, '/', 1) AS source, count(*) AS n FROM (SELECT source || CASE doc_id % 4 WHEN 0 THEN '/README.md' WHEN 1 THEN '/raw/' || doc_id || '.md' ELSE '/' || lang || '/' || doc_id || '.md' END AS path, doc_id FROM documents) WHERE doc_id % 4 >= 2 GROUP BY ALL", prelude=False)
def disk_counts(d: Domain) -> DataFrame:
    """Markdown files of each source, without indexes and raw ones."""
    from callmark.sources.markdown import disk_counts as counted

    n = F.col("doc_id").cast("string")
    rest = picked(F.col("doc_id"), F.lit("README.md"), F.concat(F.lit("raw/"), n, F.lit(".md")), *[F.concat("lang", F.lit("/"), n, F.lit(".md"))] * 2)
    return counted(d.table("documents").select(F.concat_ws("/", "source", rest).alias("path")))
