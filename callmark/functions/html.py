"""HTML as Markdown: a scanner of tags over whole pages and a stack of open elements, in Arrow batches; authors that a page links to."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmark.functions.batches import each

# Elements by how they are written, and what an opening tag closes.
DROPPED = {"script", "style", "template", "head", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "main", "nav", "p", "section", "caption"}
HEADINGS = {f"h{n}": n for n in range(1, 7)}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
BULLETS = "*+-"
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
#: Stands for a line break that keeps its two spaces.
BREAK = "\x02"


def decoded(text: str) -> str:
    """Character references as what they stand for. One without its semicolon (a title cut off, a query's &copy=) is text, as it is in Markdown."""
    return REFERENCE.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


class Element:
    """An open element: its tag, attributes and what has been written inside so far."""

    __slots__ = ("attributes", "parts", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts = tag, []
        self.attributes = {k.lower(): decoded(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}


def markdown(page: str) -> str:
    """The page as Markdown with # headings. What is not closed is closed where its parent ends or, for paragraphs, items, rows and cells, where the
    next begins; closing tags of nothing that is open are passed over."""
    stack = [Element("")]
    outer: Counter[str] = Counter()  # open tags, however deep

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            outer[done.tag] -= 1
            stack[-1].parts.append(written(done, outer))

    def close_nearest(tags: set[str], within: set[str]) -> None:
        if not any(outer[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return close_to(depth)
            if stack[depth].tag in within:
                return

    at = 0
    while at < len(page):
        top = stack[-1].tag
        if top in ("script", "style"):  # up to its own end, whatever looks like tags
            end = re.compile(rf"</{top}\s*>", re.I).search(page, at)
            close_to(len(stack) - 1)
            at = end.end() if end else len(page)
            continue
        found = TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].parts.append(shown_text(decoded(text), outer))
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0) if outer[tag] else 0
            if depth:
                close_to(depth)
            continue
        if tag in BLOCKS or tag in HEADINGS or tag in ("ul", "ol", "table", "pre", "blockquote", "hr"):
            close_nearest({"p"}, {"li", "td", "th", "blockquote", "table"})
        if tag in CLOSES:
            close_nearest(*CLOSES[tag])
        if tag in VOID:
            stack[-1].parts.append(written(Element(tag, found[3]), outer))
        else:
            stack.append(Element(tag, found[3]))
            outer[tag] += 1
    close_to(1)
    lines = re.sub(r"[ \t]*\n[ \t]*\n\s*\n", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(stack[0].parts)))
    return lines.strip("\n ").replace(BREAK, "  ")


def shown_text(text: str, outer: Counter[str]) -> str:
    if outer["pre"]:
        return text
    text = re.sub(r"\s+", " ", text)
    return text if outer["code"] else re.sub(r"([*_])", r"\\\1", text)


def around(mark: str, text: str) -> str:
    """Marks close to the text, its outer spaces outside; nothing for blank text."""
    inner = text.strip(f" \n{BREAK}")
    if not inner:
        return text
    start = text.index(inner)
    return f"{text[:start]}{mark}{inner}{mark}{text[start + len(inner):]}"


def written(e: Element, outer: Counter[str]) -> str:
    """A closed element in Markdown; outer: the tags that are open around it."""
    text, tag = "".join(e.parts), e.tag
    if tag in DROPPED or any(outer[o] for o in DROPPED):
        return ""
    if outer["pre"]:
        return text
    cell = outer["td"] or outer["th"]
    if tag == "br":
        return " " if cell else f"{BREAK}\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "img":
        title = f' "{e.attributes["title"]}"' if e.attributes.get("title") else ""
        return f"![{e.attributes.get('alt', '')}]({e.attributes.get('src', '')}{title})"
    if tag in MARKS:
        same = outer[tag] or MARKS[tag] == "`" and outer["code"]
        return text if same else around(MARKS[tag], text)
    if tag == "a":
        href, label = e.attributes.get("href", ""), text.strip(f" \n{BREAK}")
        if not href or not label:
            return text
        if label.replace("\\", "") == href and not e.attributes.get("title"):
            return f"<{href}>"
        title = f' "{e.attributes["title"]}"' if e.attributes.get("title") else ""
        return around("", f"[{label}]({href}{title})")
    if tag in HEADINGS:
        inner = re.sub(r"\s+", " ", text.replace(BREAK, "")).strip()
        return f"\n\n{'#' * HEADINGS[tag]} {inner}\n\n" if inner and not cell else inner
    if tag == "pre":
        return "\n\n```\n" + text.strip("\n") + "\n```\n\n"
    if tag == "blockquote":
        inner = tidy(text)
        return "\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n" if inner else ""
    if tag == "li":
        return f"\x03{tidy(text)}\x03"
    if tag in ("ul", "ol"):
        return listed(e, text, outer)
    if tag in ("td", "th"):
        return f"\x04{tag}\x05" + re.sub(r"\s+", " ", text.replace("\x03", " ")).strip().replace("|", "\\|")
    if tag == "tr":
        return f"\x06{text.strip()}"
    if tag == "table":
        return tabled(text)
    if tag in BLOCKS:
        return f" {text} " if cell else f"\n\n{text.strip(f' \n{BREAK}')}\n\n"
    return text


def tidy(text: str) -> str:
    """Blank lines single, none at the ends."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip(f" \n{BREAK}")


def listed(e: Element, text: str, outer: Counter[str]) -> str:
    """Items under their marks, the lines below the first indented by the mark; lists inside lists stand close."""
    depth = outer["ul"] + outer["ol"]
    first = int(e.attributes["start"]) if e.attributes.get("start", "").isdigit() else 1
    out = []
    for n, item in enumerate(re.findall(r"\x03([^\x03]*)\x03", text)):
        mark = f"{first + n}. " if e.tag == "ol" else f"{BULLETS[depth % 3]} "
        out.append(mark + item.replace("\n", "\n" + " " * len(mark)))
    gap = "\n" if outer["li"] else "\n\n"
    return gap + "\n".join(out) + gap if out else ""


def tabled(text: str) -> str:
    """Rows of a table; the first is its head, or an empty one stands for it if it has no head cells."""
    rows = [[(c[:2], c[3:].rstrip()) for c in row.split("\x04")[1:]] for row in text.split("\x06")[1:]]
    rows = [r for r in rows if r]
    if not rows:
        return text
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join([*cells, *[""] * (width - len(cells))]) + " |"
    body = [[c for _, c in r] for r in rows]
    if any(kind != "th" for kind, _ in rows[0]):
        body = [[], *body]
    return "\n\n" + "\n".join([line(body[0]), line(["---"] * width), *map(line, body[1:])]) + "\n\n"


def html_markdown(page: Column) -> Column:
    """Markdown of whole pages; null for null. A stack says what an end tag closes, so this is a vectorised function; rows stay where they are."""
    return each(page, lambda t: None if t is None else markdown(t), "string")


AUTHOR = r"/author/([^/?#\"'<>\s]+)"
LONG_NAME = 40


def page_authors(page: Column) -> Column:
    """array<struct<slug, name>> of the authors that a page links to, each once, in order: the link's text names them unless it is long, has bars or is
    blank; then the slug does. A page without such links gives the slugs in its JSON scripts."""
    decoded = lambda slug: F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    links = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*/author/[^/?#\"']+[^>]*>.*?</a>"), F.lit(0))

    def one(link: Column) -> Column:
        slug = decoded(F.regexp_extract(link, AUTHOR, 1))
        label = F.regexp_replace(F.regexp_replace(link, r"<[^>]*>", ""), r"^\s+|\s+$", "")
        good = (label != "") & ~label.rlike("[|│]") & (F.char_length(label) <= LONG_NAME)
        return F.struct(slug.alias("slug"), F.when(good, label).otherwise(slug).alias("name"))

    scripts = F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)<script\b[^>]*application/json[^>]*>(.*?)</script>"), F.lit(1)), " ")
    in_scripts = F.transform(F.regexp_extract_all(scripts, F.lit(AUTHOR), F.lit(1)), lambda s: F.struct(s.alias("slug"), s.alias("name")))
    named = F.transform(links, one)
    all_of = F.when(F.size(named) > 0, named).otherwise(in_scripts)
    return F.filter(all_of, lambda a, i: F.array_position(F.transform(all_of, lambda x: x["slug"]), a["slug"]) == i + 1)
