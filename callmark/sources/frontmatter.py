"""Front-matter as a subset of YAML: mappings and lists by indentation, flow lists and mappings, block and folded scalars, quotes; and a writer that quotes.

What is read is a VARIANT, so numbers, truths, lists and nested mappings keep their kinds; dates stay texts. What is written is read back
as it was, whatever line ends, colons, quotes or signs the values hold.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmark.functions.batches import each

KEY = re.compile(r"(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'|([^\s#\"'\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?))\s*:(?:\s+|$)")
INTEGER, NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)\Z"), re.compile(r"[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?\Z")
# Words that are no texts, and escapes in double quotes.
WORDS = {"": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
#: Text that stands for itself without quotes: begins with a letter of any script, and has no signs that end or start something.
PLAIN = r"^\p{L}[^:#\n\r\t\"'\[\]{}\x{0}-\x{1f}\x{7f}-\x{a0}\x{2028}\x{2029}\x{feff}]*\z"
NOT_PLAIN = r"(?i)^(null|true|false|yes|no|on|off)\z| \z"
DEEPEST = 50


class Unreadable(ValueError):
    pass


def scalar(text: str) -> object:
    """A plain scalar."""
    low = text.lower()
    if low in WORDS:
        return WORDS[low]
    if INTEGER.match(text):
        return int(text)
    return float(text) if NUMBER.match(text) else text


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        return "" if m[2] == "\n" else ESCAPES.get(m[2], m[2])

    joined = re.sub(r"\\(?:(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(\n|.))", one, text)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Lines:
    """The lines of front-matter, read from the top."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that is neither blank nor a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.strip()
            if bare and not bare.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise Unreadable("tab")
                return len(line) - len(line.lstrip(" ")), bare
            self.at += 1
        return None

    def node(self, indent: int, depth: int) -> object:
        """The list, mapping or scalar that begins at the next line, which is indented so far."""
        if depth > DEEPEST:
            raise Unreadable("depth")
        _, text = self.peek()
        if text == "-" or text.startswith("- "):
            return self.listed(indent, depth)
        if KEY.match(text):
            return self.mapping(indent, depth)
        self.at += 1
        return self.value(text, indent - 1, depth)

    def listed(self, indent: int, depth: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:].lstrip()
            inner = indent + len(line[1]) - len(rest)
            if rest and (KEY.match(rest) or rest.startswith("- ")):  # an item that is a node of its own
                self.lines[self.at] = " " * inner + rest
                out.append(self.node(inner, depth + 1))
            else:
                self.at += 1
                out.append(self.value(rest, indent, depth))
        return out

    def mapping(self, indent: int, depth: int) -> dict:
        out: dict[str, object] = {}
        while (line := self.peek()) and line[0] == indent:
            m = KEY.match(line[1])
            if not m:
                raise Unreadable(line[1])
            key = unescaped(m[1]) if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3]
            self.at += 1
            out[key] = self.value(line[1][m.end() :], indent, depth, in_mapping=True)
        if line and line[0] > indent:
            raise Unreadable(line[1])
        return out

    def value(self, text: str, indent: int, depth: int, in_mapping: bool = False) -> object:
        """What follows a key or a dash; it may go on over the next lines, which are indented deeper."""
        text = text if text and text[0] in "\"'[{" else re.sub(r"(^|\s)#.*$", "", text).strip()
        if re.match(r"[|>][-+]?\d?\Z", text):
            return self.block(text, indent)
        if not text:
            line = self.peek()
            if line and (line[0] > indent or in_mapping and line[0] == indent and (line[1] == "-" or line[1].startswith("- "))):
                return self.node(line[0], depth + 1)
            return None
        if text[0] in "\"'[{":
            return self.flow(text, depth)
        parts = [text]
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > indent):
            parts.append(re.sub(r"(^|\s)#.*$", "", self.lines[self.at]).strip())
            if KEY.match(parts[-1]):
                raise Unreadable(parts[-1])
            self.at += 1
        while not parts[-1]:
            parts.pop()
        return scalar(folded(parts))

    def block(self, head: str, indent: int) -> str:
        lines: list[str] = []
        own = None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            spaces = len(line) - len(line.lstrip(" "))
            if line.strip():
                if spaces <= indent:
                    break
                own = spaces if own is None else own
            lines.append(line[own or 0 :] if line.strip() else "")
            self.at += 1
        end = len(lines)
        while end and not lines[end - 1]:
            end -= 1
        text = "\n".join(lines[:end]) if head[0] == "|" else folded(lines[:end])
        return text + ("" if "-" in head or not end else "\n" * (1 + len(lines) - end) if "+" in head else "\n")

    def flow(self, text: str, depth: int) -> object:
        """A quoted scalar or a list or mapping in brackets, which ends where its quote or bracket closes, on this line or a later one."""
        while (end := closed(text)) is None:
            if self.at >= len(self.lines):
                raise Unreadable(text[:40])
            line = self.lines[self.at].strip()
            text += "\n" + line
            self.at += 1
        if re.sub(r"(^|\s)#.*$", "", text[end:]).strip():
            raise Unreadable(text[end:])
        value, _ = flow_node(text[:end], 0, depth)
        return value


def folded(lines: list[str]) -> str:
    """Lines joined: one end of a line is a space, and of more the first goes."""
    out, ends = lines[0] if lines else "", 0
    for line in lines[1:]:
        ends += 1
        if line:
            out += (" " if ends == 1 else "\n" * (ends - 1)) + line
            ends = 0
    return out + (" " if ends == 1 else "\n" * (ends - 1))


def quoted_lines(text: str) -> list[str]:
    """Lines of a quoted scalar without the white space around their ends."""
    lines = text.split("\n")
    if len(lines) == 1:
        return lines
    return [lines[0].rstrip(" \t"), *(x.strip(" \t") for x in lines[1:-1]), lines[-1].lstrip(" \t")]


_QUOTED = {'"': re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL), "'": re.compile(r"'((?:[^']|'')*+)'", re.DOTALL)}


def closed(text: str) -> int | None:
    """Where the quote or bracket that begins the text closes. A quote inside a plain word is a sign like others."""
    depth, i, before = 0, 0, ","
    while i < len(text):
        c = text[i]
        if c in _QUOTED and before in "[{,:":
            m = _QUOTED[c].match(text, i)
            if not m:
                return None
            i = m.end()
        else:
            depth += (c in "[{") - (c in "]}")
            i += 1
        if depth == 0:
            return i
        before = before if c.isspace() else c
    return None


def flow_node(text: str, i: int, depth: int) -> tuple[object, int]:
    if depth > DEEPEST:
        raise Unreadable("depth")
    i = re.compile(r"\s*").match(text, i).end()
    if text[i] in _QUOTED:
        m = _QUOTED[text[i]].match(text, i)
        if not m:
            raise Unreadable(text[i : i + 40])
        if text[i] == "'":
            return folded(quoted_lines(m[1])).replace("''", "'"), m.end()
        joined = re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", m[1])  # a backslash at its end joins a line with the next
        return unescaped(folded(quoted_lines(joined))), m.end()
    if text[i] in "[{":
        pairs, close, i = text[i] == "{", "]}"["[{".index(text[i])], i + 1
        out: list = []
        while True:
            i = re.compile(r"[\s,]*").match(text, i).end()
            if i >= len(text):
                raise Unreadable(text[:40])
            if text[i] == close:
                return (dict(out) if pairs else out), i + 1
            key, i = flow_node(text, i, depth + 1)
            i = re.compile(r"\s*").match(text, i).end()
            if pairs:
                value = None
                if text[i : i + 1] == ":":
                    value, i = flow_node(text, i + 1, depth + 1)
                out.append((key if isinstance(key, str) else json.dumps(key), value))
            else:
                out.append(key)
    m = re.compile(r"(?:[^,\[\]{}:]|:(?=\S)(?![,\]}]))*").match(text, i)
    if m.end() == i:
        raise Unreadable(text[i : i + 40])
    return scalar(folded([x.strip() for x in m[0].strip().split("\n")])), m.end()


def parsed(front: str) -> str | None:
    """Front-matter as JSON; null if it cannot be read or is no mapping."""
    try:
        lines = Lines(front)
        first = lines.peek()
        if first is None:
            return "{}"
        value = lines.node(first[0], 0)
        return json.dumps(value, ensure_ascii=False) if lines.peek() is None and isinstance(value, dict) else None
    except (Unreadable, IndexError, OverflowError, RecursionError, ValueError):
        return None


def split_front_matter(text: Column) -> Column:
    """struct<front: variant, body: string>: what stands between the first two lines of dashes, and what comes after; text without them is all body, with
    empty front-matter. front is null where it cannot be read."""
    end = F.locate("\n---\n", text, 5)
    has = text.startswith("---\n") & (end > 0)
    front = each(F.when(has, F.substring(text, F.lit(5), end - 5)), lambda t: None if t is None else parsed(t), "string")
    body = F.when(has, F.substring(text, end + 5, F.char_length(text))).otherwise(text)
    return F.struct(F.try_parse_json(F.when(~has, "{}").otherwise(front)).alias("front"), body.alias("body"))


def written(value: Column, kind: str) -> Column:
    """A value as it stands after its key: numbers and truths bare, lists and structs in brackets, texts in quotes unless they are plain."""
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return value.cast("string")
    if kind == "variant" or kind.startswith(("array", "struct", "map")):
        return F.to_json(value)
    text = value.cast("string")
    quoted = F.to_json(F.array(text))
    return F.when(text.rlike(PLAIN) & ~text.rlike(NOT_PLAIN), text).otherwise(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2))


def join_front_matter(fields: dict[str, tuple[Column, str]], body: Column) -> Column:
    """Front-matter of fields, key -> (value, its type's name), and the body after it. Null fields are left out; null bodies are empty."""
    lines = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), written(v, kind))) for k, (v, kind) in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.coalesce(body, F.lit("")))
