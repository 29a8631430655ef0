"""Opinion analytics: identities, topics, themes, current stances, flips, disagreements."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions.themes import themes_of, whole_word
from callmark.operators.ordering import running
from callmark.session import materialise

__all__ = ["attributed", "current_stance", "directional", "disagreements", "flips", "hosts", "keyword_pattern", "person_slugs", "resolve_person", "role", "themes_of"]

GENERIC = ("host", "guest", "narrator", "speaker", "unknown", "analyst", "interviewer")
GENERIC_FORM = r"^(speaker|guest|host|voice)\s*[#\d]*$"


def resolve_person(raw: Column, aliases: Mapping[str, str] | None = None, generic: Sequence[str] = GENERIC, generic_form: str = GENERIC_FORM) -> Column:
    """White space collapsed; blank and generic names are null; an alias counts as the person it stands for."""
    name = F.trim(F.regexp_replace(raw, r"\s+", " "))
    low = F.lower(name)
    nobody = low.rlike("|".join([rf"\A(?:{'|'.join(map(re.escape, ('', *generic)))})\z", f"(?:{generic_form})"]))  # one pattern and one look-up, as plans repeat what they push down
    if not aliases:
        return F.when(~nobody, name)
    first = {alias.lower(): person for alias, person in reversed(aliases.items())}
    known = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return F.when(~nobody, F.coalesce(F.try_element_at(known, low), name))


def attributed(calls: DataFrame, person: str = "person", item: str = "item_id") -> DataFrame:
    """calls with a missing person filled in by the item's only person, if it has just one."""
    only = calls.groupBy(item).agg(F.min(person).alias("__lo"), F.max(person).alias("__hi")).filter("__lo = __hi").select(item, "__lo")
    return calls.join(only, item, "left").withColumn(person, F.coalesce(person, "__lo")).drop("__lo")


def hosts(person: Column, channel: Column, fragments: Mapping[str, Sequence[str]]) -> Column:
    """Does the channel's name hold one of the person's fragments? fragments: person -> parts of the names of shows they host."""
    name = F.lower(F.coalesce(channel, F.lit("")))
    out = F.lit(False)
    for who, parts in fragments.items():
        for part in parts:
            out |= (person == who) & name.contains(part.lower())
    return F.coalesce(out, F.lit(False))


def role(is_host: Column, n_people: Column) -> Column:
    return F.when(is_host, "host").when(n_people > 1, "guest").otherwise("solo")


def keyword_pattern(keywords: Sequence[str]) -> str:
    """For lower-case text; of a few keywords (themes_of takes many)."""
    form = lambda k: rf"\b{re.escape(k)}\b" if whole_word(k) else re.escape(k)
    return "|".join(form(k.lower()) for k in keywords)


def directional(stance: Column) -> Column:
    return stance != 0


def current_stance(events: DataFrame, by: Sequence[str], fall_back: bool = True, **more: Column) -> DataFrame:
    """by, stance, seen_at: the last event that takes a side, else (if it may) the last of all; and more aggregates. events: by, stance, seen_at, ref."""
    order = F.struct("seen_at", "ref")
    last_side = F.max_by(F.struct("stance", "seen_at"), F.when(directional(F.col("stance")), order))
    last = F.coalesce(last_side, F.max_by(F.struct("stance", "seen_at"), order)) if fall_back else last_side
    found = events.groupBy(*by).agg(last.alias("__l"), *(c.alias(n) for n, c in more.items())).filter("__l IS NOT NULL")
    return found.select(*by, "__l.stance", "__l.seen_at", *more)


def flips(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Events that take the other side than the one before them that took any, on a later day."""
    w = Window.partitionBy(*by).orderBy("seen_at", "ref")
    sided = events.filter(directional(F.col("stance"))).withColumns({"prev_stance": F.lag("stance").over(w), "prev_at": F.lag("seen_at").over(w)})
    return sided.filter((F.col("prev_stance") == -F.col("stance")) & (F.col("seen_at") > F.col("prev_at")))


def disagreements(latest: DataFrame) -> DataFrame:
    """topic, bulls, bears of topics on which people stand on both sides. latest: topic, person, stance."""
    n = lambda s: F.count_if(F.col("stance") == s)
    return latest.groupBy("topic").agg(n(1).alias("n_bulls"), n(-1).alias("n_bears")).filter("n_bulls > 0 AND n_bears > 0")


def person_slugs(people: DataFrame, person: str = "person", order: str | None = None) -> DataFrame:
    """people with slug: the name's, or person-NNN, counted in order over those whose name leaves none. people: a row a person;
    they are written once, as they are read for the numbers and for the rest."""
    from callmark.functions.text import page_slug

    own = materialise(people).withColumn("slug", F.nullif(page_slug(F.col(person)), F.lit("untitled")))
    nameless = running(own.filter("slug IS NULL"), [F.col(c) for c in dict.fromkeys((order or person, person))])
    number = (F.col("place") + 1).cast("string")
    numbered = nameless.withColumn("slug", F.concat(F.lit("person-"), F.lpad(number, F.greatest(F.lit(3), F.char_length(number)), F.lit("0")))).select(*own.columns)
    return own.filter("slug IS NOT NULL").unionByName(numbered)
