"""Themes by keywords: all keywords of all themes in one pass over a text, by an automaton."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmark.functions.batches import each

# The themes and their keywords in both languages, and what counts as talk about rates.
THEMES: dict[str, list[str]] = {
    "precious-metals": ["gold", "silver", "platinum", "palladium", "precious metal", "GC=F", "SI=F", "PL=F", "PA=F"],
    "oil-energy": ["crude oil", "wti", "brent", "oil price", "oil", "CL=F", "RB=F", "strategic petroleum", "energy"],
    "rates-bonds": ["treasury", "10-year", "rates", "bond", "fixed income", "interest rate", "dollar", "dixie", "^TNX", "DX-Y.NYB", "monetary policy", "yen", "JPY=X", "USDJPY"],
    "ai-semiconductors": ["nvidia", "semiconductor", "ai ", "a.i.", "chip", "micron", "compute", "NVDA", "MU", "MRVL", "SMH", "TER", "openai", "microsoft", "hyperscaler", "anthropic"],
    "macro-indices": ["s&p", "sp500", "s&p500", "nasdaq", "^GSPC", "SPY", "^IXIC", "^KS11", "macro", "economy", "gdp", "recession", "depression", "index"],
    "crypto": ["bitcoin", "crypto", "stablecoin", "btc", "BTC-USD", "ethereum"],
    "electrification-industrials": ["utility", "utilities", "power", "electrif", "transformer", "grid", "industrial", "data center", "NEE", "VST", "GEV", "PH", "ETN", "TKR", "POWL", "PWR", "PRIM", "Eaton", "Constellation"],
    "china-hk-equities": ["hk", "hong kong", "china", "tencent", "alibaba", "jd.com", "京東", "騰訊", "阿里", "港股", "a股", "0700", "海力士"],
    "uranium-nuclear": ["uranium", "nuclear", "smr", "oklo", "ccj"],
    "china-property": ["real estate", "property", "房地產", "地產", "樓市", "楼市", "房價", "房价", "發展商", "开发商", "housing"],
    "credit-private-credit": ["credit", "bdc", "private debt", "private credit", "structured", "default", "high yield", "junk"],
    "agriculture-food": ["agriculture", "agricultural", "food", "softs", "wheat", "corn", "soybean", "coffee", "sugar", "cocoa", "DBA", "grain"],
    "robotics-autonomy": ["robotics", "robot", "humanoid", "automation", "autonomous", "self-driving", "robotaxi"],
    "geopolitics-defense": ["geopolit", "defense", "defence", "war ", "tariff", "sanction", "hormuz", "taiwan", "election"],
}
RATES_CONTEXT = ["treasury", "rates", "interest rate", "bond", "yield", "monetary policy", "fed", "fomc", "rate cut", "rate hike"]


def whole_word(keyword: str) -> bool:
    """Keywords of ASCII letters alone match as whole words, others (codes, phrases, other scripts) anywhere."""
    return keyword.isascii() and keyword.isalpha()


@lru_cache(maxsize=8)
def _automaton(themes: tuple[tuple[str, tuple[str, ...]], ...]):
    """Built once for a Python worker: keyword -> (its length, is it a whole word, the places of its themes)."""
    import ahocorasick

    places: dict[str, set[int]] = {}
    for i, (_, keywords) in enumerate(themes):
        for k in keywords:
            places.setdefault(k.lower(), set()).add(i)
    automaton = ahocorasick.Automaton()
    for k, own in places.items():
        automaton.add_word(k, (len(k), whole_word(k), own))
    automaton.make_automaton()
    return automaton


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def found(text: str, automaton) -> set[int]:
    """Places of the themes with a keyword in a text; the edges of words are checked at each hit."""
    low, out = text.lower(), set()
    for end, (size, word, own) in automaton.iter(low):
        if own <= out or word and (end >= size and _in_word(low[end - size]) or end + 1 < len(low) and _in_word(low[end + 1])):
            continue
        out |= own
    return out


def themes_of(text: Column, themes: Mapping[str, Sequence[str]] = THEMES) -> Column:
    """Array of the themes with a keyword in the text, in the table's order; one pass over the text, however many keywords. A null text has none."""
    table = tuple((name, tuple(k for k in words if k)) for name, words in themes.items())
    if not any(words for _, words in table):
        return F.array().cast("array<string>")
    return each(text, lambda t: [table[i][0] for i in sorted(found(t or "", _automaton(table)))], "array<string>")
