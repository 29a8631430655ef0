"""Two sides of one catalog held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("missing", "orphans", "mismatches", "fine", "repeated_rows", "repeated_files", "unreadable")


def compared(rows: DataFrame, files: DataFrame) -> DataFrame:
    """source and COUNTS. rows and files: key, source, content (null counts as no content to compare); a file without a key could not be read.

    A key that a side has more than once is compared by its least source and content and counted as repeated. One shuffle by key on
    each side, combined before it, and one full join; a key never gathers its repeats.
    """
    once = lambda df, s: df.filter("key IS NOT NULL").groupBy("key").agg(F.min("source").alias(f"{s}_source"), F.min("content").alias(f"{s}_content"), (F.count(F.lit(1)) - 1).alias(f"{s}_more"))
    both = once(rows, "row").join(once(files, "file"), "key", "full")
    no_file, no_row = F.col("file_more").isNull(), F.col("row_more").isNull()
    zero = F.lit(0).cast("long")
    found = both.select(
        F.coalesce("row_source", "file_source").alias("source"), no_file.cast("long").alias("missing"), no_row.cast("long").alias("orphans"), F.coalesce((F.col("row_content") != F.col("file_content")).cast("long"), zero).alias("mismatches"),
        F.coalesce((F.col("row_content") == F.col("file_content")).cast("long"), zero).alias("fine"), F.coalesce("row_more", zero).alias("repeated_rows"), F.coalesce("file_more", zero).alias("repeated_files"), zero.alias("unreadable"))
    broken = files.filter("key IS NULL").select("source", *(zero.alias(c) for c in COUNTS[:-1]), F.lit(1).cast("long").alias("unreadable"))
    return found.unionByName(broken).groupBy("source").agg(*(F.sum(c).alias(c) for c in COUNTS))
