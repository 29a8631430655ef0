"""Column functions of text: slugs, dates in titles and pages, cleaning, fingerprints, paragraphs, chunks."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from callmark.functions.batches import each

# Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FIRST_DATE = "2005-04-23"
BLOCKED = ("429", "too many requests", "sign in to confirm", "protect our community", "ip has been blocked")
GONE = ("private", "unavailable", "removed", "deleted", "members-only", "terminated")
TITLE_ISO = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
TITLE_DMY = r"(?iU)\b(\d{1,2})(?:st|nd|rd|th)?\s*([A-Za-z]{3,9})\s*,?\s*(\d{4})\b"
TITLE_MDY = r"(?iU)\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&#39;": "'"}
PAUSE_SECONDS = 2.5
PARAGRAPH_CHARS, CHUNK_CHARS = 600, 14_000


def slug(text: Column, most: int = 80) -> Column:
    """Letters, digits and marks of any script, joined by hyphens; 'x' if nothing is left."""
    kept = F.lower(F.trim(F.regexp_replace(text, r"(?U)[^\w\s-]", "")))
    return F.coalesce(F.nullif(F.regexp_replace(F.left(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), F.lit(most)), r"^-+|-+$", ""), F.lit("")), F.lit("x"))


def page_slug(text: Column) -> Column:
    """ASCII letters, digits, dots, underscores and hyphens; 'untitled' if nothing is left."""
    joined = F.regexp_replace(F.lower(F.trim(text)), r"[\s/\\:|]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9._-]", ""), r"-{2,}", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("untitled"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, most: int) -> Column:
    one_line = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(one_line) > most, F.concat(F.rtrim(F.left(one_line, F.lit(most - 1))), F.lit("…"))).otherwise(one_line)


def md_escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def show_date(text: Column) -> Column:
    return F.when(text.isNull(), "n/d").otherwise(F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), F.left(text, F.lit(10))))


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))


def _ymd(year: Column, month: Column, day: Column, until: Column) -> Column:
    made = F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(made.between(F.lit(FIRST_DATE).cast("date"), until), F.date_format(made, "yyyyMMdd"))


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3)))), F.lit(0))


def title_date(title: Column, until: Column) -> Column:
    """yyyymmdd of the first form that gives a day from FIRST_DATE to until: ISO, then day-month-year, then month-day-year."""
    part = lambda p, i: F.regexp_extract(title, p, i)
    return F.coalesce(
        _ymd(part(TITLE_ISO, 1), part(TITLE_ISO, 2), part(TITLE_ISO, 3), until), _ymd(part(TITLE_DMY, 3), _month(part(TITLE_DMY, 2)), part(TITLE_DMY, 1), until),
        _ymd(part(TITLE_MDY, 3), _month(part(TITLE_MDY, 1)), part(TITLE_MDY, 2), until))


def upload_date(html: Column, until: Column) -> Column:
    p = r'"(?:uploadDate|publishDate)"\s*:\s*"(\d{4})-(\d\d)-(\d\d)'
    return _ymd(*(F.regexp_extract(html, p, i) for i in (1, 2, 3)), until)


def stem_date(path: Column) -> Column:
    return F.try_to_date(F.regexp_extract(path, r"(?:^|/)(\d{4}-\d\d-\d\d)-[^/]*$", 1), "yyyy-MM-dd")


def quarter_end(text: Column) -> Column:
    """Last day of the quarter in 2025-q4 or 1q2024."""
    a, b = r"(?i)(20\d\d)-q([1-4])", r"(?i)([1-4])q(20\d\d)"
    year = F.coalesce(F.nullif(F.regexp_extract(text, a, 1), F.lit("")), F.nullif(F.regexp_extract(text, b, 2), F.lit("")))
    quarter = F.coalesce(F.nullif(F.regexp_extract(text, a, 2), F.lit("")), F.nullif(F.regexp_extract(text, b, 1), F.lit("")))
    return F.last_day(F.make_date(year.cast("int"), quarter.cast("int") * 3, F.lit(1)))


def error_class(text: Column) -> Column:
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(has(BLOCKED), "blocked").when(has(GONE), "gone")


def fingerprint(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, "\n"), 256)


#: Networks that are private, of this host, of links, reserved, or for documentation and tests.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PRIVATE_V6 = (
    "::/8", "64:ff9b:1::/48", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3",
    "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10",
)


def _within(bits: Column, networks: Sequence[str], size: int) -> Column:
    """Is the address, a text of size bits, in one of the networks?"""
    heads = [format(int(n.network_address), f"0{size}b")[: n.prefixlen] for n in map(ipaddress.ip_network, networks)]
    return reduce(lambda a, h: a | bits.startswith(h), heads, F.lit(False))


def _bits(numbers: Column, base: int, width: int) -> Column:
    """Numbers (texts in a base) as bits of that width, joined."""
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.conv(x, base, 2), width, "0")), "")


def safe_url(url: Column) -> Column:
    """http(s), and a host that is a name other than localhost, or an address that is not private, of this host, of a link or reserved; IPv4 addresses
    written in IPv6 ones lie in a reserved network."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]]*)(?::\d*)?(?:[/?#]|$)", 1))
    v4 = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    four = lambda of: F.array(*(F.regexp_extract(of, v4, i) for i in range(1, 5)))
    is_v4 = host.rlike("^" + v4) & F.forall(four(host), lambda x: x.try_cast("int") <= 255)
    inner = F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), "%.*$", "")
    # the dotted end as two groups, then the groups that '::' stands for
    hexed = lambda i: F.lower(F.hex(F.get(four(inner), F.lit(i)).try_cast("int") * 256 + F.get(four(inner), F.lit(i + 1)).try_cast("int")))
    plain = F.when(inner.rlike(v4), F.concat(F.regexp_replace(inner, v4, ""), hexed(0), F.lit(":"), hexed(2))).otherwise(inner)
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: x != "")
    head, tail = groups(F.substring_index(plain, "::", 1)), groups(F.when(plain.contains("::"), F.substring_index(plain, "::", -1)).otherwise(""))
    all_groups = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))), tail)
    is_v6 = host.startswith("[") & (F.size(all_groups) == 8) & F.forall(all_groups, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
    bits = _bits(all_groups, 16, 16)
    good = F.when(host.startswith("["), is_v6 & ~_within(bits, PRIVATE_V6, 128)).when(is_v4, ~_within(_bits(four(host), 10, 8), PRIVATE_V4, 32)).otherwise(~host.isin("", "localhost"))
    return F.coalesce(good, F.lit(False))


def html_text(html: Column) -> Column:
    no_code = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def capped(paragraph: Column, most: int = PARAGRAPH_CHARS) -> Column:
    """Array of pieces of at most so many characters, each as many whole sentences as fit; a longer sentence stands alone.

    White space must be single spaces. One scan: the rest if it fits, else the longest run of sentences that does, else one sentence.
    """
    end = r"[.!?](?= |\z)"
    pieces = rf"\S.{{0,{most - 1}}}\z|(?:\S.{{0,{most - 2}}})?{end}|\S.*?{end}|\S.*\z"
    return F.when(F.char_length(paragraph) <= most, F.array(paragraph)).otherwise(F.regexp_extract_all(paragraph, F.lit(pieces), F.lit(0)))


def paragraphs(text: Column, most: int = PARAGRAPH_CHARS) -> Column:
    """Array of paragraphs: split at blank lines and '>>', which goes; white space collapsed; capped at so many characters."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n|\s*>>\s*"), collapse), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: capped(p, most)))


def pieces(sizes: np.ndarray, gap: int, most: int) -> list[tuple[int, int]]:
    """(first, end) of runs of units that fill up to most characters, gap between two: for each unit where a piece that begins there ends is
    looked up among the running lengths, and pieces are followed from the first on. A longer unit is a piece of its own."""
    ends = np.cumsum(sizes + gap)
    after = np.maximum(np.searchsorted(ends, ends - sizes + most, "right"), np.arange(1, len(sizes) + 1)).tolist()
    out, at = [], 0
    while at < len(sizes):
        out.append((at, after[at]))
        at = after[at]
    return out


def packed(text: str, most: int) -> list[str]:
    """The text whole if short enough; else its paragraphs filled into pieces; of a long paragraph the words, of a long word the characters."""
    text = text.strip()
    if len(text) <= most:
        return [text]
    out: list[str] = []
    paragraphs = re.split(r"\n{2,}", text)
    for first, end in pieces(np.array([len(p) for p in paragraphs]), 2, most):
        if len(paragraphs[first]) <= most:
            out.append("\n\n".join(paragraphs[first:end]).strip())
            continue
        words = paragraphs[first].split(" ")
        for a, b in pieces(np.array([len(w) for w in words]), 1, most):
            out += [" ".join(words[a:b]).strip()] if len(words[a]) <= most else [words[a][i : i + most] for i in range(0, len(words[a]), most)]
    return [p for p in out if p]


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Array of chunks. What a chunk holds depends on all before it, so this is a vectorised function; rows stay where they are."""
    return each(text, lambda t: packed(t or "", most), "array<string>")


def json_after(text: Column, marker: str) -> Column:
    """The first balanced object after the marker; null without one. Braces in strings do not count.

    The text from the brace on is cut into strings, braces and the rest; a running sum over the braces finds the end.
    """
    after = F.when(F.instr(text, marker) > 0, F.substring(text, F.instr(text, marker) + len(marker), F.char_length(text))) if marker else text
    rest = F.substring(after, F.nullif(F.instr(after, "{"), F.lit(0)), F.char_length(after))
    parts = F.regexp_extract_all(rest, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^"{}]++|".*'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("chars"), F.lit(False).alias("closed"))

    def step(at: Column, part: Column) -> Column:
        depth = at["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        return F.when(at["closed"], at).otherwise(F.struct(depth.alias("depth"), (at["chars"] + F.char_length(part)).alias("chars"), (depth == 0).alias("closed")))

    end = F.aggregate(parts, start, step)
    return F.when(end["closed"], F.substring(rest, F.lit(1), end["chars"]))


def loose_json(raw: Column) -> Column:
    """A JSON object in fences, else the first balanced one; null if there is none that parses."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", ""))
    pick = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.startswith("{"), x)
    return F.coalesce(pick(bare), pick(json_after(raw, "")))


def clean_caption(line: Column) -> Column:
    """Without tags; entities as what they stand for."""
    out = F.regexp_replace(line, r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def cue_blocks(vtt: Column) -> Column:
    """array<struct<start, stop, text>> of a caption file: hours optional, dot or comma, lines cleaned and joined; blank cues and those that say
    what the one before said are dropped."""
    clock = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"

    def seconds(of: Column, pattern: str) -> Column:
        n = lambda i: F.coalesce(F.nullif(F.regexp_extract(of, pattern, i), F.lit("")), F.lit("0")).cast("double")
        return F.when(of.rlike(pattern), n(1) * 3600 + n(2) * 60 + n(3) + n(4) / 1000)

    # a line with an arrow, and the lines after it up to a blank one or the next arrow
    blocks = F.regexp_extract_all(F.regexp_replace(vtt, r"\r\n?", "\n"), F.lit(r"(?m)^[^\n]*-->[^\n]*(?:\n(?![^\n]*-->)[^\n]*\S[^\n]*)*+"), F.lit(0))
    said = lambda b: F.array_join(F.filter(F.transform(F.slice(F.split(b, "\n"), F.lit(2), F.size(F.split(b, "\n"))), clean_caption), lambda x: x != ""), " ")
    start = lambda b: seconds(b, rf"^\s*{clock}")
    stop = lambda b: F.coalesce(seconds(F.regexp_extract(b, r"-->[ \t]*([^\s]*)", 1), rf"^{clock}"), start(b))
    cues = F.filter(F.transform(blocks, lambda b: F.struct(start(b).alias("start"), stop(b).alias("stop"), said(b).alias("text"))), lambda c: c["start"].isNotNull() & (c["text"] != ""))
    return F.filter(cues, lambda c, i: (i == 0) | (c["text"] != F.get(cues, i - 1)["text"]))


def caption_paragraphs(vtt: Column) -> Column:
    """Array of a caption file's paragraphs: a new one at '>>', which goes, and after a pause of over PAUSE_SECONDS; capped in length."""
    cues = F.transform(cue_blocks(vtt), lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["text"].startswith(">>").alias("speaker"), F.trim(F.regexp_replace(c["text"], "^>+", "")).alias("text")))
    cues = F.filter(cues, lambda c: c["text"] != "")
    breaks = lambda c, i: F.when((i > 0) & (c["speaker"] | (c["start"] - F.get(cues, i - 1)["stop"] > PAUSE_SECONDS)), F.lit("\n\n")).otherwise(F.lit(" "))
    return paragraphs(F.array_join(F.transform(cues, lambda c, i: F.concat(breaks(c, i), c["text"])), ""))


def html_meta(html: Column) -> dict[str, Column]:
    """n_links, first_href, last_page (greatest page= of a link, else 1), title ('?' without), total (paragraphs) of a listing page."""
    hrefs = F.regexp_extract_all(html, F.lit(r'<a\b[^>]*href="([^"]*)"'), F.lit(1))
    pages = F.transform(F.filter(hrefs, lambda x: x.rlike(r"page=\d+")), lambda x: F.regexp_extract(x, r"page=(\d+)", 1).cast("int"))
    return {"n_links": F.size(hrefs).cast("long"), "first_href": F.get(hrefs, F.lit(0)), "last_page": F.coalesce(F.array_max(pages), F.lit(1)),
            "title": F.coalesce(F.nullif(F.regexp_extract(html, r"<title>([^<]*)</title>", 1), F.lit("")), F.lit("?")), "total": F.regexp_count(html, F.lit(r"<p\b")).cast("long")}


def digest16(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256: names a cached prose or study."""
    return F.left(F.sha2(text, 256), F.lit(16))


def descriptor(blob: Column) -> Column:
    """struct<external_id, url, title, published_at, channel_ref> of a discovery record in JSON; null without an id.

    The channel is the handle, else the author's slug or handle; a date that is none is null.
    """
    get = lambda p: F.get_json_object(blob, f"$.{p}")
    text = lambda p: F.nullif(F.trim(get(p)), F.lit(""))
    channel = F.coalesce(text("channel_handle"), F.coalesce(F.trim(F.nullif(get("author.slug"), F.lit(""))), F.trim(get("author.handle"))))
    at = F.try_to_timestamp(F.replace(get("published_at"), F.lit("Z"), F.lit(""))).cast("timestamp_ntz")
    made = F.struct(text("external_id").alias("external_id"), get("url").alias("url"), get("title").alias("title"), at.alias("published_at"), F.nullif(channel, F.lit("")).alias("channel_ref"))
    return F.when(text("external_id").isNotNull(), made)


def vector_text(vector: Column) -> Column:
    """[x,y,...] with six decimals."""
    def six(x: Column) -> Column:
        micros = F.round(x.cast("double") * 1e6).cast("long")
        size = F.lpad(F.abs(micros).cast("string"), F.greatest(F.lit(7), F.char_length(F.abs(micros).cast("string"))), F.lit("0"))
        return F.concat(F.when(micros < 0, "-").otherwise(""), F.left(size, F.char_length(size) - 6), F.lit("."), F.right(size, F.lit(6)))

    return F.concat(F.lit("["), F.array_join(F.transform(vector, six), ","), F.lit("]"))
