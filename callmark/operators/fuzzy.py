"""Fuzzy matching of titles and topics: by equi-joins on the rarest piece of a text, with the exact condition checked on what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a slug that tell a title; words that two titles must share otherwise, and letters of a word.
PREFIX_CHARS, SHARED_WORDS, WORD = 24, 3, "[a-z]{4,}"
#: Characters by which containment is looked up, and keys that hold a piece and meet in one task at most.
GRAM, HOT_KEYS = 3, 20_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def grams(text: Column, size: int) -> Column:
    """All different pieces of this size."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - size + 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.char_length(text) >= size, F.array_distinct(places)).otherwise(F.array().cast("array<string>"))


def candidates(short: DataFrame, long: DataFrame, size: int = GRAM) -> DataFrame:
    """short, long: different keys (key) of both sides, of so many letters and more, that share the piece of the short key that fewest long keys hold.

    A short key with a piece that no long key holds meets none. A piece that very many long keys hold is dealt to several tasks by the long key.
    """
    pieces = long.select("key", F.explode(grams(F.col("key"), size)).alias("gram"))
    seen = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = short.select("key", F.explode(grams(F.col("key"), size)).alias("gram")).join(seen, "gram", "left")
    rarest = own.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    asked = rarest.select(F.col("key").alias("short"), "r.gram", F.ceil(F.col("r.n") / HOT_KEYS).cast("int").alias("tasks"))
    dealt = pieces.join(asked.select("gram", "tasks").distinct(), "gram").select("gram", F.col("key").alias("long"), F.pmod(F.xxhash64("key"), F.col("tasks")).cast("int").alias("task"))
    return asked.select("short", "gram", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")).join(dealt, ["gram", "task"]).select("short", "long")


def within(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
    """a (of short) and b (of long), exact: where short.key, not blank, lies in long.key. Different keys are compared, once, and then name their rows."""
    ours, theirs = short.filter("key <> ''").select(a, "key"), long.filter("key <> ''").select(b, "key")
    one, two = ours.select("key").distinct(), theirs.select("key").distinct()
    found = candidates(one.filter(F.char_length("key") >= GRAM), two).filter(F.contains("long", "short"))
    for size in range(1, GRAM):  # keys too short to have a piece are pieces themselves
        tiny = one.filter(F.char_length("key") == size)
        if not tiny.isEmpty():
            found = found.unionByName(tiny.select(F.col("key").alias("short")).join(two.select(F.col("key").alias("long"), F.explode(grams(F.col("key"), size)).alias("short")), "short").select("short", "long"))
    named = found.join(ours.withColumnRenamed("key", "short"), "short").join(theirs.withColumnRenamed("key", "long"), "long")
    return named.select(a, b, (F.col("long") == F.col("short")).alias("exact"))


def contained(asked: DataFrame, a: str, topics: DataFrame, b: str) -> DataFrame:
    """a, b: for each asked name the topics of its normalised key, else those whose key holds its own or lies in it."""
    one, two = asked.select(a, normal(F.col(a)).alias("key")), topics.select(b, normal(F.col(b)).alias("key"))
    both = within(one, two, a, b).unionByName(within(two, one, b, a).select(a, b, "exact")).distinct()
    exact = both.groupBy(a).agg(F.max("exact").alias("__any"))
    return both.join(exact, a).filter(F.col("exact") | ~F.col("__any")).select(a, b)


def same_title(wanted: DataFrame, files: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, by_prefix, by_number, by_tokens of the pairs for which any holds. wanted: a, slug, number; files: b, stem (with mv-<number>).

    Words are put in one order, rarest in files first; a pair that shares SHARED_WORDS shares one that is not among either
    side's SHARED_WORDS - 1 commonest, so common words, which would pair everything, are not joined on.
    """
    heads, stems = wanted.select(a, F.left("slug", F.lit(PREFIX_CHARS)).alias("key")), files.select(b, F.col("stem").alias("key"))
    prefix = within(heads, stems, a, b).select(a, b, F.lit(1).alias("way"))
    digits = F.regexp_extract_all("stem", F.lit(r"mv-(\d+)"), F.lit(1))
    starts = F.array_distinct(F.flatten(F.transform(digits, lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda n: F.substring(x, F.lit(1), n)))))
    number = wanted.select(a, F.col("number").alias("__n")).join(files.select(b, F.explode(starts).alias("__n")), "__n").select(a, b, F.lit(2).alias("way"))

    words = lambda df, key, c: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))).alias("__words"))
    ours, theirs = words(wanted, a, "slug"), words(files, b, "stem")
    common = theirs.select(F.explode("__words").alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("__seen"))

    def rare(df: DataFrame, key: str) -> DataFrame:
        """key, __words in order, and each of them but for the commonest as __word."""
        each = df.filter(F.size("__words") >= SHARED_WORDS).select(key, F.explode("__words").alias("__word")).join(common, "__word")
        ordered = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__seen", "__word"))), lambda x: x["__word"]).alias("__words"))
        return ordered.select("*", F.explode(F.slice("__words", F.lit(1), F.greatest(F.lit(0), F.size("__words") - SHARED_WORDS + 1))).alias("__word"))

    pairs = rare(ours, a).join(rare(theirs, b).withColumnRenamed("__words", "__theirs"), "__word")
    shared = F.array_intersect("__words", "__theirs")
    tokens = pairs.filter((F.size(shared) >= SHARED_WORDS) & (F.get(shared, F.lit(0)) == F.col("__word"))).select(a, b, F.lit(3).alias("way"))
    any_way = prefix.unionByName(number).unionByName(tokens).groupBy(a, b)
    return any_way.agg(*(F.max(F.col("way") == n).alias(name) for n, name in ((1, "by_prefix"), (2, "by_number"), (3, "by_tokens"))))
