"""Cleaning of titles, bodies, handles, links and model output; natural sort keys; paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmark.functions.text import MONTHS, collapse, slug

# Fixed values.
CTA = r"(?is)\n[^\n]*(?:subscribe now|click here to|sign up for)\b.*\z"
DISCLAIMER = r"(?is)\n[^\n]*\bdisclaimer\b.*\z"
NO_TRANSCRIPT = "_(no transcript available)_"
EXCERPT_MARK = "（節錄）"
FULL_CHARS = 400


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def channel_slug(handle: Column, name: Column, key: Column) -> Column:
    made = lambda c: F.when(blank_to_null(c).isNotNull(), F.nullif(slug(F.regexp_replace(c, "^@", "")), F.lit("x")))
    return F.coalesce(made(handle), made(name), F.concat(F.lit("ch-"), key.cast("string")))


def free_date(text: Column) -> Column:
    """The first of MM/DD/YYYY, Month D, YYYY, D Month YYYY and YYYY/MM/DD that is a day."""
    def made(pattern: str, y: int, m: int, d: int, named: bool) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(part(m), F.lit(3)))).cast("string") if named else part(m)
        return F.try_to_date(F.concat_ws("-", part(y), F.lpad(month, 2, "0"), F.lpad(part(d), 2, "0")), "yyyy-MM-dd")

    return F.coalesce(made(r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 1, 2, False), made(r"(?i)\b([a-z]{3,9})\.? (\d{1,2}), (\d{4})", 3, 1, 2, True), made(r"(?i)\b(\d{1,2}) ([a-z]{3,9}) (\d{4})", 3, 2, 1, True), made(r"\b(\d{4})/(\d{1,2})/(\d{1,2})\b", 1, 2, 3, False))


def clean_title(title: Column) -> Column:
    """Without what sites append: quarter tags and dates at the end, up to three of them."""
    return F.trim(F.regexp_replace(title, r"(?i)(?:\s*[-|–(,]?\s*(?:q[1-4]\s*20\d\d|[1-4]q\s*20\d\d|[a-z]{3,9} \d{1,2}, 20\d\d)\)?){1,3}\s*$", ""))


def strip_boilerplate(body: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.regexp_replace(body, CTA, ""), DISCLAIMER, ""))


def from_heading(body: Column, generic: tuple[str, ...] = ("column", "opinion", "home")) -> Column:
    """The body from its first level-one heading on, or from the second if the first is generic; without headings as it is."""
    lines = F.split(body, "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("# "), i)), lambda i: i.isNotNull())
    first = F.get(at, F.lit(0))
    is_generic = F.lower(F.trim(F.substring(F.get(lines, first), 3, 1_000_000))).isin(*generic)
    start = F.when(is_generic & (F.size(at) > 1), F.get(at, F.lit(1))).otherwise(first)
    return F.when(start.isNull(), body).otherwise(F.array_join(F.slice(lines, start + 1, F.size(lines)), "\n"))


def vanity(raw: Column) -> Column:
    """A creator's name from a handle, a path or an address: the vanity parameter, else what follows c/, cw/ or user/, else the first part of the path;
    null if there is none."""
    asked = F.trim(F.regexp_extract(raw, r"(?i)[?&]vanity=([^&#]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^(https?:)?//[^/?#]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    named = F.when(first.isin("c", "cw"), F.coalesce(second, first)).when(first == "user", second).otherwise(first)
    return F.coalesce(F.nullif(asked, F.lit("")), F.nullif(F.regexp_replace(named, r"^@", ""), F.lit("")))


def at_handle(raw: Column) -> Column:
    return F.concat(F.lit("@"), vanity(raw))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.isNull() | (url == ""), "").when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def is_full(body: Column) -> Column:
    """Long enough, not ending in an ellipsis, and not marked as an excerpt; headings, starred and blank lines do not count."""
    kept = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^([#*]|\s*$)"))
    text = F.trim(F.array_join(kept, "\n"))
    return (F.char_length(text) >= FULL_CHARS) & ~text.rlike(r"(…|\.\.\.)$") & ~text.contains(EXCERPT_MARK)


def has_transcript(body: Column) -> Column:
    return ~body.contains(NO_TRANSCRIPT)


def as_replacement(text: Column) -> Column:
    """Text that stands for itself where a pattern's match is replaced."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def as_pattern(text: Column) -> Column:
    """A pattern that matches this text alone."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def patch_metadata(body: Column, duration: Column, published: Column, description: Column) -> Column:
    """Duration and Published lines replaced, an empty Description filled; doing it again changes nothing."""
    def line(text: Column, name: str, value: Column) -> Column:
        return F.when(value.isNull(), text).otherwise(F.regexp_replace(text, F.lit(rf"(?m)^(- \*\*{name}:\*\*).*$"), F.concat(F.lit("$1 "), as_replacement(value))))

    out = line(line(body, "Duration", duration), "Published", published)
    return F.when(description.isNull(), out).otherwise(F.regexp_replace(out, F.lit(r"(?m)^## Description\n+(?=##|\z)"), F.concat(F.lit("## Description\n\n"), as_replacement(description), F.lit("\n\n"))))


def sanitise_links(text: DataFrame, pages: DataFrame, key: str, column: str) -> DataFrame:
    """text with links to unknown pages as their labels; _ and - in names are tried for each other. pages: page."""
    found = text.select(key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"\]\(([^)\s]+\.md)\)"), F.lit(1)))).alias("target"))
    known = pages.select(F.col("page").alias("__page"), F.replace("page", F.lit("_"), F.lit("-")).alias("__form")).groupBy("__form").agg(F.collect_set("__page").alias("__pages"))
    best = F.when(F.array_contains("__pages", F.col("target")), F.col("target")).otherwise(F.array_min("__pages"))
    fate = found.withColumn("__form", F.replace("target", F.lit("_"), F.lit("-"))).join(known, "__form", "left").groupBy(key).agg(F.collect_list(F.struct("target", best.alias("best"))).alias("__fate"))

    def one(out: Column, f: Column) -> Column:
        link = F.concat(F.lit(r"\[([^\]]*)\]\("), as_pattern(f["target"]), F.lit(r"\)"))
        return F.regexp_replace(out, link, F.when(f["best"].isNull(), F.lit("$1")).otherwise(F.concat(F.lit("[$1]("), as_replacement(f["best"]), F.lit(")"))))

    joined = text.join(fate, key, "left")
    return joined.withColumn(column, F.when(F.col("__fate").isNull(), F.col(column)).otherwise(F.aggregate("__fate", F.col(column), one))).drop("__fate")


def topic_lines(text: Column) -> Column:
    """array<struct<topic, recurring, new, changes>> of lines 'TOPIC: a | RECURRING: b | NEW: c', each with the lines 'CHANGE: "q" -> w' below it."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*TOPIC:[^\n]*(?:\n(?![ \t]*TOPIC:)[^\n]*)*+"), F.lit(0))
    head = r"(?i)^\s*TOPIC:\s*(.+?)\s*\|\s*RECURRING:\s*(\S+)\s*\|\s*NEW:\s*([^\n]*)"
    change = r'(?im)^[ \t]*CHANGE:\s*"([^"\n]*)"\s*->\s*([^\n]*)$'
    changes = lambda b: F.transform(F.regexp_extract_all(b, F.lit(change), F.lit(0)), lambda c: F.struct(F.trim(F.regexp_extract(c, change, 1)).alias("quote"), F.trim(F.regexp_extract(c, change, 2)).alias("what")))
    made = lambda b: F.struct(F.regexp_extract(b, head, 1).alias("topic"), F.lower(F.regexp_extract(b, head, 2)).startswith("y").alias("recurring"), F.trim(F.regexp_extract(b, head, 3)).alias("new"), changes(b).alias("changes"))
    return F.transform(F.filter(blocks, lambda b: b.rlike(head)), made)


def numbered_tags(text: Column, most: Column | None = None) -> Column:
    """array<struct<i, tags>> of lines 'i | tag; tag' (or with commas), of numbers under most; lines without a tag go."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d+\s*\|"))
    tags = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, r"\|(.*)$", 1), "[;,]"), lambda t: F.trim(t)), lambda t: t != "")
    rows = F.transform(lines, lambda x: F.named_struct(F.lit("i"), F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"), F.lit("tags"), tags(x)))
    return F.filter(rows, lambda r: (F.size(r["tags"]) > 0) & (F.lit(True) if most is None else r["i"] < most))


def quote_at(text: Column, quote: Column) -> Column:
    """Where the quote stands, white space and case apart; else where its first 50 characters do; else null."""
    norm = lambda c: F.lower(collapse(c))
    found = lambda q: F.nullif(F.instr(norm(text), q), F.lit(0))
    return F.coalesce(found(norm(quote)), found(F.left(norm(quote), F.lit(50))))


def version_key(version: Column) -> Column:
    """Orders v2 before v10."""
    return F.struct(F.coalesce(F.regexp_extract(version, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("number"), version.alias("version"))


def content_path(source: Column, channel: Column, published: Column, title: Column) -> Column:
    year = F.coalesce(F.date_format(published, "yyyy"), F.lit("undated"))
    return F.concat_ws("/", source, slug(channel), year, F.concat(F.concat_ws("-", F.date_format(published, "yyyy-MM-dd"), slug(title)), F.lit(".md")))


def in_public_subset(path: Column, channels: list[str] | None, first: str | None, last: str | None) -> Column:
    """source/channel/.../YYYY-MM-DD-name: of an allowed channel (None allows all), dated within both days; undated files stay out if a day is given."""
    day = F.try_to_date(F.regexp_extract(path, r"(?:^|/)(\d{4}-\d\d-\d\d)[^/]*$", 1), "yyyy-MM-dd")
    allowed = F.lit(True) if channels is None else F.get(F.split(path, "/"), F.lit(1)).isin(*channels)
    return allowed & (F.coalesce(day >= F.lit(first).cast("date"), F.lit(False)) if first else F.lit(True)) & (F.coalesce(day <= F.lit(last).cast("date"), F.lit(False)) if last else F.lit(True))


def first_label(lines: DataFrame, line: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first non-blank uploader or channel of JSON lines, in order, of each group; broken lines are passed over."""
    label = F.coalesce(blank_to_null(F.get_json_object(line, "$.uploader")), blank_to_null(F.get_json_object(line, "$.channel")))
    return lines.select(*by, label.alias("label"), order).filter("label IS NOT NULL").groupBy(*by).agg(F.min_by("label", order).alias("label"))


def asset_row(kind: Column, raw: Column) -> Column:
    """struct<id, title, url> of an asset in JSON, whichever of its kinds it is; others are null."""
    get = lambda *names: F.coalesce(*(F.get_json_object(raw, f"$.{n}") for n in names))
    return F.when(kind.isin("Story", "Video", "Outlink"), F.struct(get("uuid", "id").alias("id"), get("title", "headline").alias("title"), F.when(kind == "Outlink", get("outlinkUrl")).otherwise(get("canonicalUrl.url", "url")).alias("url")))
