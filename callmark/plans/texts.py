"""Text, page, date, JSON and document functions over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.functions import html as ht
from callmark.functions import text as tx
from callmark.functions import variants as va
from callmark.plans.registry import query
from callmark.session import work_dir
from callmark.sources import frontmatter as fm
from callmark.sources import markdown as md
from callmark.sources.domain import Domain

_TEXT = "regexp_replace(regexp_replace(regexp_replace(html, '(<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->)', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')"


@query(f"WITH t AS (SELECT page_id, trim({_TEXT}) AS t FROM pages) SELECT page_id, t AS text, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words FROM t", prelude=False)
def page_text(d: Domain) -> DataFrame:
    rows = d.table("pages").select("page_id", tx.html_text(F.col("html")).alias("text"))
    return rows.withColumn("n_words", tx.word_count(F.col("text")).cast("long"))


@query("SELECT page_id, i - 1 AS place, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages))", prelude=False)
def page_links(d: Domain) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*href="([^"]*)"'), F.lit(1))
    return d.table("pages").select("page_id", F.posexplode(found).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


@query("SELECT page_id, coalesce(regexp_extract(url, 'page=(\\d+)', 1), '') AS page_no, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS first_part, regexp_matches(url, '(?i)^https?://') AND NOT regexp_matches(url, '^https?://(localhost|127|10\\.)') AS safe FROM pages", prelude=False)
def page_urls(d: Domain) -> DataFrame:
    url = F.col("url")
    return d.table("pages").select("page_id", F.regexp_extract(url, r"page=(\d+)", 1).alias("page_no"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.regexp_extract(url, r"^https?://[^/]+/([^/?#]*)", 1).alias("first_part"), tx.safe_url(url).alias("safe"))


def _markdown_sql() -> str:
    """For the pages' own form: headings, links in a list, paragraphs one of which leaves its emphasis open, boxes, entities."""
    text = "regexp_replace(html, '(<head>.*?</head>|<script\\b.*?</script>|<!--.*?-->)', '', 'gs')"
    steps = [("\\s+", " "), ("([*_])", "\\\\\\1"), ("<b>([^<]*?)\\s*<br>", "**\\1**"), ('<a href="([^"]*)">([^<]*)</a>', "[\\2](\\1)"), ("<h1>([^<]*)</h1>", "#P## \\1#P#"), ("<li>([^<]*)</li>", "#L#* \\1"), ("</?(p|div|nav|article|footer|ul)\\b[^>]*>", "#P#"), ("<[^>]*>", "")]
    for p, r in steps:
        text = f"regexp_replace({text}, '{p}', '{r}', 'g')"
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    for p, r in ((" *(#P#|#L#) *", "\\1"), ("(#P#|#L#)*#P#(#P#)*", "#P#")):
        text = f"regexp_replace({text}, '{p}', '{r}', 'g')"
    return f"SELECT page_id, trim(replace(replace({text}, '#P#', chr(10) || chr(10)), '#L#', chr(10)), ' ' || chr(10)) AS markdown FROM pages"


@query(_markdown_sql(), prelude=False)
def page_markdown(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", ht.html_markdown(F.col("html")).alias("markdown"))


@query("""SELECT page_id, i AS place, slug, CASE WHEN length('By ' || slug) > 40 THEN slug ELSE 'By ' || slug END AS name FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS i FROM
(SELECT page_id, h[k] AS slug, min(k) AS k FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS k FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="/([^"/?#]*)"', 1), lambda x: x <> '') AS h FROM pages)) GROUP BY page_id, slug))""", prelude=False)
def page_authors(d: Domain) -> DataFrame:
    """Authors told by a page's links, each once; names that are too long, with bars or blank give way to the slug."""
    html = F.regexp_replace("html", r'<a href="/([^"/?#]*)">[^<]*</a>', '<a class="x" href="https://example.com/author/$1?ref=1"><b>By $1</b></a>')
    rows = d.table("pages").select("page_id", F.posexplode(ht.page_authors(html)).alias("place", "a"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "a.slug", "a.name")


@query("SELECT page_id, len(h) AS n_links, h[1] AS first_href, coalesce(list_max(list_transform(list_filter(h, lambda x: regexp_matches(x, 'page=\\d+')), lambda x: regexp_extract(x, 'page=(\\d+)', 1)::INTEGER)), 1) AS last_page, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '?') AS title, len(regexp_extract_all(html, '<p\\b')) AS total FROM (SELECT page_id, html, regexp_extract_all(html, '<a\\b[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages)", prelude=False)
def page_meta(d: Domain) -> DataFrame:
    """Links, last page number, title and result total told by a page's HTML."""
    html = F.col("html")
    rows = d.table("pages").select("page_id", F.struct(*(x.alias(n) for n, x in tx.html_meta(html).items())).alias("m"))
    return rows.select("page_id", "m.*")


_SLUG = "regexp_replace(lower(trim(regexp_replace(title, '[^\\p{L}\\p{N}_\\s-]', '', 'g'))), '[\\s_-]+', '-', 'g')"


@query(f"""WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents) SELECT doc_id, coalesce(nullif(regexp_replace(left({_SLUG}, 80), '^-+|-+$', '', 'g'), ''), 'x') AS slug,
CASE WHEN length(title) > 60 THEN rtrim(left(title, 59)) || '…' ELSE title END AS short, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS collapsed, replace(title, '|', '\\|') AS escaped FROM t""", prelude=False)
def title_forms(d: Domain) -> DataFrame:
    t = d.table("documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    title = F.col("title")
    return t.select("doc_id", tx.slug(title).alias("slug"), tx.shorten(title, 60).alias("short"), tx.collapse(title).alias("collapsed"), tx.md_escape(title).alias("escaped"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 >= 4 THEN NULL ELSE strftime(o_orderdate + INTERVAL 20 YEAR, '%Y%m%d') END AS dated, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderdate + INTERVAL 20 YEAR)::DATE END AS stem,
last_day(make_date(2020 + o_orderkey::INT % 5, (o_orderkey::INT % 4 + 1) * 3, 1)) AS quarter_end FROM orders""", prelude=False)
def title_dates(d: Domain) -> DataFrame:
    """Dates found again in titles, file names and quarter slugs that were made from dates; forms that only look like dates give none."""
    k, on = F.col("o_orderkey"), F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")
    show = lambda form: F.date_format(on, form)
    forms = (F.concat(F.lit("Notes "), show("yyyy-MM-dd")), F.concat(show("dMMMyyyy"), F.lit(" outlook")), F.concat(F.lit("The week of "), show("MMMM d, yyyy")), F.concat(show("d"), F.lit("th "), show("MMM yyyy")),
             F.concat(F.lit("x1"), show("ddMMMyyyy")), show("yyyy.M.d"), F.concat(F.lit("No date "), F.lit("15May 1987")), F.concat(show("yyyy-M"), F.lit("-100 and 30 Feb 2020")))
    title = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    path = F.when(k % 5 == 0, F.concat(F.lit("/blog/2020/"), show("yyyy-MM-dd"), F.lit("-name.md"))).otherwise(F.lit("/blog/undated-name.md"))
    quarter = F.concat((2020 + k % 5).cast("string"), F.lit("-q"), (k % 4 + 1).cast("string"))
    return d.table("orders").select(k.alias("id"), tx.title_date(title, F.lit("2030-01-01").cast("date")).alias("dated"), tx.stem_date(path).alias("stem"), tx.quarter_end(quarter).alias("quarter_end"))


_ERRORS = ("HTTP Error 429: Too Many Requests; video unavailable", "Sign in to protect our community", "Private video. Sign in if you've been granted access", "This video was deleted", "Join for members-only content", "account terminated", "connection reset by peer", "Video unavailable")


@query("""SELECT event_id, CASE WHEN event_id % 8 < 2 THEN 'blocked' WHEN event_id % 8 <> 6 THEN 'gone' END AS class, (props->>'k')::INT AS k, (props->>'k') IS NOT NULL AS has_k,
'{"k":' || CASE WHEN event_id % 3 = 0 THEN '{"old":' || (props->>'k') || '}' ELSE (props->>'k') END || ',"ok":' || (value > 20) || ',"type":"' || event_type || '","user":{"id":' || user_id || '}}' AS merged FROM events""", prelude=False)
def event_json(d: Domain) -> DataFrame:
    """JSON paths with casts, presence, right-wins merging that keeps numbers, truths and objects, and classes of error texts."""
    blob = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 8 + 1).cast("int"))
    k = F.get_json_object("props", "$.k")
    more = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit('}, "ok": '), (F.col("value") > 20).cast("string"), F.lit(', "type": "'), "event_type", F.lit('"'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "k": {"old": '), k, F.lit("}"))).otherwise(""), F.lit("}"))
    merged = va.shown(va.merged(va.fields(F.col("props")), va.fields(more)))
    return d.table("events").select("event_id", tx.error_class(blob).alias("class"), k.try_cast("int").alias("k"), k.isNotNull().alias("has_k"), merged.alias("merged"))


@query("SELECT event_id, i - 1 AS place, CASE i WHEN 1 THEN event_type ELSE 'user' || user_id END AS entity FROM events, range(1, 3) r(i)", prelude=False)
def nested_records(d: Domain) -> DataFrame:
    """Records in JSON flattened."""
    raw = F.concat(F.lit('{"entities":[{"name":"'), "event_type", F.lit('"},{"name":"user'), F.col("user_id").cast("string"), F.lit('"}]}'))
    rows = d.table("events").select("event_id", F.posexplode(va.records(raw, "$.entities")).alias("place", "e"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), va.text_of(F.col("e"), "$.name").alias("entity"))


#: What stands between two records: other kinds of elements, and a record without a name.
_BETWEEN = ("null", '"bare text"', "17.5", '[{"name":"inner"}]', "true", '{"kind":"theme"}')


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 6 THEN i - 1 END AS place, CASE WHEN event_id % 7 = 6 OR event_id % 7 = 5 AND i = 2 THEN NULL WHEN i = 1 THEN event_type ELSE user_id::VARCHAR END AS entity FROM events, range(1, 4) r(i) WHERE i = 1 OR event_id % 7 = 5 OR i = 2 AND event_id % 7 <> 6""", prelude=False)
def nested_entities(d: Domain) -> DataFrame:
    """Records with an element between them that is no record, which is passed over alone; a seventh of the texts is cut off and gives an empty row."""
    between = F.element_at(F.array(*map(F.lit, _BETWEEN), F.lit("")), (F.col("event_id") % 7 + 1).cast("int"))
    raw = F.concat(F.lit('{"entities":[{"name":"'), "event_type", F.lit('"},'), between, F.when(F.col("event_id") % 7 == 6, "").otherwise(F.concat(F.lit(',{"name":'), F.col("user_id").cast("string"), F.lit("}]}"))))
    rows = d.table("events").select("event_id", F.posexplode_outer(va.records(raw, "$.entities")).alias("place", "e"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), va.text_of(F.col("e"), "$.name").alias("entity"))


def filling(units: str, out: str, most: int, gap: str) -> str:
    """CTEs for greedy filling in SQL: units (run, i from 1, unit) -> out (run, first, piece). From each unit the end of a piece that
    begins there is looked up; pieces are then followed from the first on. Wants WITH RECURSIVE."""
    n = len(gap)
    shown = "' '" if gap == " " else "chr(10) || chr(10)"
    return f"""{out}_u AS (SELECT run, i, unit, sum(length(unit)) OVER w + {n} * i AS e, sum(length(unit)) OVER w - length(unit) + {n} * i AS b FROM {units} WINDOW w AS (PARTITION BY run ORDER BY i)),
{out}_n AS (SELECT a.run, a.i, greatest(a.i, coalesce(c.i, 0)) + 1 AS nxt FROM {out}_u a ASOF LEFT JOIN {out}_u c ON a.run = c.run AND a.b + {most} >= c.e),
{out}_s AS (SELECT run, i, nxt FROM {out}_n WHERE i = 1 UNION ALL SELECT n.run, n.i, n.nxt FROM {out}_s s JOIN {out}_n n ON n.run = s.run AND n.i = s.nxt),
{out} AS (SELECT s.run, s.i AS first, string_agg(u.unit, {shown} ORDER BY u.i) AS piece FROM {out}_s s JOIN {out}_u u ON u.run = s.run AND u.i >= s.i AND u.i < s.nxt GROUP BY ALL)"""


# paragraphs (p) of long texts; runs of those that fit (pr), and of the words of those that do not (wr), filled; characters of long words
_CHUNKS = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(t, '\\n{{2,}}') AS l FROM t WHERE length(t) > 1800)),
pg AS (SELECT *, count(*) FILTER (WHERE length(p) > 1800) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM p),
pr AS (SELECT (doc_id, g) AS run, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS i, p AS unit, k FROM pg WHERE length(p) <= 1800),
{filling("pr", "pc", 1800, "\n\n")},
w AS (SELECT doc_id, k, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, k, string_split(p, ' ') AS l FROM p WHERE length(p) > 1800)),
wg AS (SELECT *, count(*) FILTER (WHERE length(w) > 1800) OVER (PARTITION BY doc_id, k ORDER BY j) AS g FROM w),
wr AS (SELECT (doc_id, k, g) AS run, row_number() OVER (PARTITION BY doc_id, k, g ORDER BY j) AS i, w AS unit, j FROM wg WHERE length(w) <= 1800),
{filling("wr", "wc", 1800, " ")},
c AS (SELECT pr.run[1] AS doc_id, pr.k, 0 AS j, 0 AS c, piece FROM pc JOIN pr ON pr.run = pc.run AND pr.i = pc.first
    UNION ALL SELECT wr.run[1], wr.run[2], wr.j, 0, piece FROM wc JOIN wr ON wr.run = wc.run AND wr.i = wc.first
    UNION ALL SELECT doc_id, k, j, s, substring(w, s + 1, 1800) FROM (SELECT *, unnest(range(0, length(w), 1800)) AS s FROM w WHERE length(w) > 1800)
    UNION ALL SELECT doc_id, 0, 0, 0, t FROM t WHERE length(t) <= 1800)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j, c) - 1)::INTEGER AS idx, piece AS text FROM c"""


@query(_CHUNKS, prelude=False)
def document_chunks(d: Domain) -> DataFrame:
    """Its SQL is for texts whose words stand a space or line end apart."""
    rows = d.table("documents").select("doc_id", tx.chunks(F.col("text"), 1_800).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("idx", "text"))


def _sentences(source: str, key: str) -> str:
    """CTEs: source (key, k, p: paragraphs of single spaces) -> par (key, k, first, piece)."""
    return f"""u AS (SELECT ({key}, k) AS run, unnest(l) AS unit, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(p, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS l FROM {source})),
{filling("u", "f", 600, " ")},
par AS (SELECT run[1] AS key, run[2] AS k, first, piece FROM f)"""


@query(f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS r, conv_id, turn, string_split_regex(text, '\\n\\s*\\n|\\s*>>\\s*') AS l FROM conversations),
p AS (SELECT r, unnest(range(1, len(l) + 1)) AS k, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS p FROM s), q AS (SELECT * FROM p WHERE p <> ''), {_sentences("q", "r")}
SELECT conv_id, turn, (row_number() OVER (PARTITION BY r ORDER BY k, first) - 1)::INTEGER AS place, piece AS paragraph FROM par JOIN s ON s.r = par.key""", prelude=False)
def transcript_paragraphs(d: Domain) -> DataFrame:
    return d.table("conversations").select("conv_id", "turn", F.posexplode(tx.paragraphs(F.col("text"))).alias("place", "paragraph"))


_CUES = f"""c AS (SELECT conv_id, turn, role, said, CASE WHEN turn % 5 = 4 THEN '>> ' || said ELSE said END AS shown, turn * 4.0::DOUBLE + CASE WHEN turn % 3 = 2 THEN 3 ELSE 0 END AS start
    FROM (SELECT conv_id, turn, min(role) AS role, min(role) || ' & ' || (turn // 2) || '. ' || trim(regexp_replace(min(text), '[<>&\\s]+', ' ', 'g')) AS said FROM conversations GROUP BY conv_id, turn)),
k AS (SELECT *, start + 2.0 AS stop, lag(shown) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c), kept AS (SELECT * FROM k WHERE shown IS DISTINCT FROM before),
b AS (SELECT *, CASE WHEN start - lag(stop) OVER w > 2.5 OR turn % 5 = 4 AND lag(stop) OVER w IS NOT NULL THEN 1 ELSE 0 END AS brk FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM b),
q AS (SELECT conv_id, k, string_agg(said, ' ' ORDER BY turn) AS p FROM g GROUP BY conv_id, k)"""


@query(f"WITH RECURSIVE {_CUES}, {_sentences('q', 'conv_id')} SELECT key AS conv_id, (row_number() OVER (PARTITION BY key ORDER BY k, first) - 1)::INTEGER AS place, piece AS paragraph FROM par", prelude=False)
def caption_paragraphs(d: Domain) -> DataFrame:
    """Captions written as cues, parsed, and joined until a pause, a change of speaker or the length cap."""
    turn = F.col("turn")
    start = turn * 4 + F.when(turn % 3 == 2, 3).otherwise(0)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = lambda s: F.when(s < 600, F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60), F.lit(".000"))).otherwise(F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), F.concat(two(s % 60), F.lit(",000"))))
    body = F.trim(F.regexp_replace(F.min("text"), r"[<>&\s]+", " "))
    said = d.table("conversations").groupBy("conv_id", "turn").agg(F.concat(F.min("role"), F.lit("</c> &amp; "), F.floor(turn / 2).cast("string"), F.lit(".\n"), body).alias("said"))
    cue = F.concat(clock(start), F.lit(" --> "), clock(start + 2), F.lit(" align:start\n"), F.when(turn % 5 == 4, "&gt;&gt; ").otherwise(""), F.lit("<c>"), "said")
    vtt = said.select("conv_id", "turn", cue.alias("cue")).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cue"))), lambda x: x["cue"]), "\n\n")).alias("vtt"))
    return vtt.select("conv_id", F.posexplode(tx.caption_paragraphs(F.col("vtt"))).alias("place", "paragraph"))


@query("""SELECT page_id, url, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), NULL) AS title, 'n/a: ' || page_id || chr(10) || 'url: "no" \\ #x' AS note, sha256(html) AS raw, page_id % 2 = 0 AS even, [url, 'a: b', '- "c"', 'it''s', ''] AS tags,
page_id * 0.5::DOUBLE AS half, 'yes' AS word, length(html) AS n FROM pages""", prelude=False)
def front_matter(d: Domain) -> DataFrame:
    """Pages written as Markdown with front-matter and read again: texts with line ends, colons, quotes and whole HTML, lists, a second level, numbers, truths."""
    title = F.nullif(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit(""))
    note = F.concat(F.lit("n/a: "), F.col("page_id").cast("string"), F.lit('\nurl: "no" \\ #x'))
    tags = F.array("url", *map(F.lit, ("a: b", '- "c"', "it's", "")))
    text = fm.join_front_matter({
        "page_id": (F.col("page_id"), "bigint"), "url": (F.col("url"), "string"), "title": (title, "string"), "nothing": (F.lit(None), "string"), "note": (note, "string"), "raw": (F.col("html"), "string"),
        "even": (F.col("page_id") % 2 == 0, "boolean"), "tags": (tags, "array<string>"), "more": (F.struct((F.col("page_id") * 0.5).alias("half"), F.lit("yes").alias("word")), "struct"),
    }, F.col("html"))
    read = d.table("pages").select(fm.split_front_matter(text).alias("f")).select("f.front", "f.body")
    get = lambda path, kind: F.try_variant_get("front", f"$.{path}", kind)
    return read.select(get("page_id", "bigint").alias("page_id"), get("url", "string").alias("url"), get("title", "string").alias("title"), get("note", "string").alias("note"), F.sha2(get("raw", "string"), 256).alias("raw"), get("even", "boolean").alias("even"),
                       get("tags", "array<string>").alias("tags"), get("more.half", "double").alias("half"), get("more.word", "string").alias("word"), F.char_length("body").cast("long").alias("n"))


@query("WITH p AS (SELECT lang || '/' || source || '/' || doc_id AS path FROM documents) SELECT string_split(path, '/')[1] AS folder, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], count(*) FROM p GROUP BY ALL", prelude=False)
def folder_counts(d: Domain) -> DataFrame:
    return md.prefix_counts(d.table("documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path")))


def landed(events: DataFrame) -> DataFrame:
    """Wide price rows by type and day, without a close where the volume is divisible by 7."""
    e = events.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("last"), F.count(F.lit(1)).alias("volume"))
    wide = e.withColumn("close", F.when(F.col("volume") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("last"))).withColumn("open", F.lit(None).cast("string"))
    return md.wide_prices(wide).drop("open")


@query("SELECT event_type AS ticker, ts::DATE AS day, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL HAVING count(*) % 7 <> 0", prelude=False)
def landed_prices(d: Domain) -> DataFrame:
    """Wide price rows as they land, with NaN for missing: rows without a close go."""
    return landed(d.table("events"))


@query("SELECT 'src' || page_id % 7 || '/' || coalesce(nullif(regexp_extract(url, '^https?://[^/]+/([a-zA-Z]+)', 1), ''), 'none') || '/' || page_id || '.md' AS path, sha256('# ' || page_id || chr(10) || html) AS digest FROM pages", prelude=False)
def markdown_files(d: Domain) -> DataFrame:
    """Pages written as Markdown files and read back from their folders; files under raw are left out, and writing them again writes none."""
    from callmark.sources.sinks import write_pages

    folder = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([a-zA-Z]+)", 1), F.lit("")), F.lit("none"))
    path = F.concat(F.lit("src"), (F.col("page_id") % 7).cast("string"), F.lit("/"), folder, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md"))
    pages = d.table("pages").select(path.alias("path"), F.concat(F.lit("# "), F.col("page_id").cast("string"), F.lit("\n"), "html").alias("text"))
    raw = pages.select(F.concat(F.lit("raw/"), "path").alias("path"), "text")
    root = work_dir(d.spark)
    write_pages(pages.unionByName(raw), root)
    if write_pages(pages.unionByName(raw), root)[0]:
        raise AssertionError("files that were there were written again")
    read = md.read_markdown(d.spark, root)
    name = root.split("/")[-1]
    return read.select(F.substring_index("path", f"{name}/", -1).alias("path"), F.sha2("text", 256).alias("digest"))
