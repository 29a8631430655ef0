"""Mixing sources to target weights along a time-varying curriculum (operator 6).

Each source has a weight; the sources share the words of the whole table by weight, but none gets more than ``most``
times its own words: what is over is shared again by weight among the others. The target of a source is met by repeating
all its documents a whole number of times and some of them, in an order given by a hash, once more; a document that is
over a fiftieth of its source comes first where at least half of the words are wanted once more, else last, so that
hardly ever one of that size straddles the point where the target is met.

A curriculum says when the words of a source are wanted: over training time t in [0, 1] its weight moves in a straight
line from ``start`` to ``2 - start`` times its mean. The integral of that line is the source's cumulative demand
D(t) = target * (start * t + (1 - start) * t^2); a document copy whose middle is the source's c-th word is trained on at
the t where D(t) = c, found in closed form. Range-sorting by that position puts the copies in training order.

Running sums over a source never gather it in one task: documents fall into buckets of the order's hash, sums of whole
buckets are added up first, and sums within a bucket last. Rows that agree in id, source and size are one row until then,
with their number, so an id (or its lack) that many rows have is no hot key. Sources, which may be as many as hosts, are
ranked and filled by ranges too.

Defined results: a null or blank text has no words, is taken 0 words and put at its place with 0 copies; a long text counts
whole, as one document; a null source is a source of its own, last in order; repeated rows are documents of their own, tied
in order; a table without words gives targets of 0, an empty one no rows; other columns, whatever their names, are ignored
by ``mix``, and kept by ``training_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import few, materialise, name, record, running, spread_join, table, whole

#: What separates words, and the weights of sources in order, repeating.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Hexadecimal digits of the order's hash that make a bucket: 4,096 buckets for each source.
BUCKET_DIGITS = 3
#: A document over one part in so many of its source is placed first or last, the largest outermost.
GIANT = 50
#: A source's weight at t = 0 against its mean, by its place in order, repeating: early, even, late.
STARTS = (1.5, 1.0, 0.5)
#: Sources up to so many meet the documents by broadcast, some 100 bytes each.
BROADCAST_SOURCES = 1_000_000
#: Rows of one kind that a task writes out; more are dealt anew.
ROWS_PER_BLOCK = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight, start, target of each source; sizes: source, source_size.

    The level at which sharing again ends is found at once: with the sources in order of the share at which they are
    full (most * size / weight), a prefix is full and the rest has the level (total - full sizes) / (weights of the rest);
    the first level that is at most the next one's own share is it. The table has a row for each source, and no text.
    """
    place = F.col("place") % len(weights)
    ranked = running(sizes, [F.col("source").asc_nulls_last()]).select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight"), F.element_at(F.array(*map(F.lit, STARTS)), (place % len(STARTS) + 1).cast("int")).alias("start"))
    ranked = ranked.withColumn("full_at", F.col("source_size") * most / F.col("weight"))
    filling = running(ranked, [F.col("full_at").asc(), F.col("source").asc_nulls_last()], full_size=F.col("source_size"), full_weight=F.col("weight")).drop("place")
    everything = F.broadcast(ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight")))  # one row, as the level
    rest_size, rest_weight = F.col("all_size") - most * F.col("full_size"), F.col("all_weight") - F.col("full_weight")
    # after the first row that is not full, levels only fall: the largest that a row allows is the level
    level = filling.join(everything).agg(F.max(F.when(rest_size <= F.col("full_at") * rest_weight, rest_size / rest_weight)).alias("level"))
    target = F.least((F.col("source_size") * most).cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return ranked.join(F.broadcast(level)).select("source", "source_size", "weight", "start", target.alias("target"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, bool]:
    """A row for all rows of docs that agree in doc_id, source and size: these, their number c, what the words before them (ahead) and the
    target say; and whether any of these rows stands for very many."""
    own = docs.select(F.col(name(id_col)).cast("long").alias("doc_id"), F.col(name(source_col)).cast("string").alias("source"), words(whole(name(text_col))).alias("size"))
    own = materialise(own.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("c")).withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))))
    often = not own.filter(F.col("c") > ROWS_PER_BLOCK).isEmpty()
    sizes = materialise(own.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")))
    plan = targets(sizes, weights, most).withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size")).withColumnRenamed("source", "source_").drop("weight")
    if few(sizes, BROADCAST_SOURCES):
        plan = F.broadcast(plan)
    giant = F.col("size") * GIANT > F.col("source_size")
    side = F.when(giant, F.when(F.col("left") * 2 >= F.col("source_size"), -1).otherwise(1)).otherwise(0)
    own = own.join(plan, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumn("side", side)
    own = own.withColumn("bucket", F.when(F.col("side") < 0, "").when(F.col("side") > 0, "z").otherwise(F.left("order_key", F.lit(BUCKET_DIGITS))))
    weight = F.col("size") * F.col("c")
    buckets = own.groupBy("source", "bucket").agg(F.sum(weight).alias("bucket_size"))
    of_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), F.coalesce(F.sum("bucket_size").over(of_source), F.lit(0)).alias("before_bucket"))
    within = Window.partitionBy("source", "bucket").orderBy(F.col("side") * F.col("size"), "order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = own.withColumn("done", F.sum(weight).over(within)).join(ahead, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    return placed.select("doc_id", "source", "size", "c", "source_size", "target", "start", "rounds", "left", (F.col("before_bucket") + F.col("done") - weight).alias("ahead")), often


def _each(planned: DataFrame, often: bool) -> DataFrame:
    """A row for each row of docs: n (its number among its equals, from 0), before (words before it), copies; rows that repeat very often are dealt over tasks."""
    numbers = lambda first, end: F.explode(F.sequence(first, end - 1))
    if often:
        planned = materialise(planned)
        blocks = planned.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / ROWS_PER_BLOCK)))).repartition("doc_id", "size", "block")
        first = F.col("block") * ROWS_PER_BLOCK
        rare = blocks.withColumn("n", numbers(first, F.least(first + ROWS_PER_BLOCK, F.col("c")))).drop("block")
    else:
        rare = planned.withColumn("n", numbers(F.lit(0).cast("long"), F.col("c")))
    before = F.col("ahead") + F.col("n") * F.col("size")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("rounds") + F.when(F.col("before") + F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).cast("int")
    return rare.withColumn("before", before).withColumn("copies", copies)


def _positions() -> Column:
    """Training positions of a row's copies, in order."""
    demand = lambda k: F.col("before") + F.col("size") / 2 + k * F.col("source_size")
    made = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("copies")) - 1), lambda k: position(demand(k), F.col("target"), F.col("start")))
    return F.when(F.col("copies") > 0, made).otherwise(F.array().cast("array<double>"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, positions, n, before; a row for each row of docs.

    positions: when each copy of the document is trained on, from 0 to 1.
    """
    rows = _each(*_planned(docs, id_col, text_col, source_col, seed, weights, most)).withColumn("positions", _positions())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", "n", "before", "c")


def position(demand: Column, target: Column, start: Column) -> Column:
    """The t in [0, 1] where target * (start * t + (1 - start) * t^2) is the demand."""
    share = F.least(F.lit(1.0), F.try_divide(demand.cast("double"), target))
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * (1 - start) * share))
    return 2 * share / (start + root)


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs' rows, each as often as the mix has copies of it, range-sorted by training position; docs' columns only.

    The plan, a few numbers for each document, meets the documents on id, source and size, and the sort moves them once more.
    Only rows that agree in all three with others are numbered before, over ranges of their texts' hashes.
    """
    plan = materialise(mix(docs, id_col, text_col, source_col, **how).filter("copies > 0").select(_key(F.col("doc_id"), F.col("source"), F.col("size")).alias("at"), "n", "c", "positions"))
    rows = record(docs, key=_key(F.col(name(id_col)).cast("long"), F.col(name(source_col)), words(whole(name(text_col)))))
    single = rows.join(plan.filter("c = 1"), F.col("key") == F.col("at")).select("record", "key", F.lit(0).cast("long").alias("n"), "positions")
    several = plan.filter("c > 1")
    if not several.isEmpty():
        known = several.select(F.col("at").alias("key")).distinct()
        numbered = rows.join(F.broadcast(known) if few(known, BROADCAST_SOURCES) else known, "key", "left_semi")
        numbered = materialise(numbered.withColumns({"hash": F.xxhash64(f"record.{name(text_col)}"), "row": F.monotonically_increasing_id()}))
        numbered = running(numbered, [F.col(c) for c in ("key", "hash", "row")])
        firsts = numbered.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
        numbered = spread_join(numbered, firsts, "key", "rows").withColumn("nth", F.col("place") - F.col("first"))
        single = single.unionByName(numbered.join(several, (F.col("key") == F.col("at")) & (F.col("nth") == F.col("n"))).select("record", "key", F.col("n").cast("long").alias("n"), "positions"))
    return _sorted(single).select(*(F.col(f"record.{name(c)}").alias(c) for c in docs.columns))


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, source, position of every copy that the mix has, in training_order's order, without texts."""
    plan = mix(docs, id_col, text_col, source_col, **how).withColumn("key", _key(F.col("doc_id"), F.col("source"), F.col("size")))
    return _sorted(plan).select("doc_id", "source", "position")


def _sorted(placed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted. Training time is what the words are spread over evenly, so equal spans of it are the ranges: no sampling."""
    ranges = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = placed.select("*", F.explode("positions").alias("position"))
    span = F.least(F.lit(ranges - 1), F.floor(F.col("position") * ranges)).cast("int")
    return copies.repartitionById(ranges, span).sortWithinPartitions("position", "key", "n")


def _key(doc_id: Column, source: Column, size: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("none")), size.cast("string"), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("none")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with the places of all its copies, range-sorted by the first's; documents without copies come last."""
    first = F.get("positions", F.lit(0))
    rows = materialise(mix(table(spark, sf_dir, "documents"))).orderBy(first.asc_nulls_last(), _key(F.col("doc_id"), F.col("source"), F.col("size")), "n")
    ppm = lambda x: F.floor(x * 1e6)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", ppm(first).alias("position_ppm"), F.array_join(F.transform("positions", lambda x: ppm(x).cast("string")), ",").alias("positions_ppm"))


ORACLE = r"""
WITH own AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('mix:' || coalesce(doc_id::VARCHAR, 'none')) AS order_key
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source
), ranked AS (
    SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS place FROM sizes
), weighed AS (
    SELECT *, place + 1 AS weight, CASE place WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS start,
        (source_size * 3)::DOUBLE / (place + 1)::DOUBLE AS full_at FROM ranked
), prefixes AS (
    SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0))::DOUBLE AS rest_size,
        (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS rest_weight
    FROM weighed WINDOW w AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
    SELECT max(rest_size / rest_weight) AS level FROM prefixes WHERE rest_size <= full_at * rest_weight
), plan AS (
    SELECT source, source_size, start, least((source_size * 3)::DOUBLE, coalesce(level, 0.0::DOUBLE) * weight::DOUBLE) AS target FROM weighed, lev
), sided AS (
    SELECT own.doc_id, own.size, own.order_key, plan.*,
        CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS rounds,
        target - (rounds * source_size)::DOUBLE AS remaining,
        CASE WHEN own.size * 50 > source_size THEN CASE WHEN remaining * 2 >= source_size::DOUBLE THEN -1 ELSE 1 END ELSE 0 END AS side
    FROM own JOIN plan ON own.source IS NOT DISTINCT FROM plan.source
), placed AS (
    SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY side, side * size, order_key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
    FROM sided
), copied AS (
    SELECT *, before::DOUBLE + size::DOUBLE / 2 AS demand,
        (CASE WHEN size = 0 THEN 0 ELSE rounds + CASE WHEN before::DOUBLE + size::DOUBLE / 2 <= remaining THEN 1 ELSE 0 END END)::INTEGER AS copies
    FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, ps[1] AS position_ppm, array_to_string(ps, ',') AS positions_ppm FROM (SELECT *, list_transform(range(0, copies),
    lambda k: floor(2 * least(1.0::DOUBLE, (demand + k * source_size::DOUBLE) / target) / (start + sqrt(greatest(0.0::DOUBLE, start * start + 4 * (1 - start) * least(1.0::DOUBLE, (demand + k * source_size::DOUBLE) / target)))) * 1e6::DOUBLE)::BIGINT) AS ps
FROM copied)
"""
