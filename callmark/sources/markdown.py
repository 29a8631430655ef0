"""Markdown files: reading, counting, what changed; landed prices. Front-matter is in frontmatter.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, text of every .md below path, but for folders named raw."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").contains("/raw/"))


def prefix_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """folder, n: how many files lie below each folder, at any depth."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.filter(F.col(path).contains("/")).select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def disk_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """source, n: Markdown files by first folder, without README.md and what lies under a folder named raw."""
    parts = F.split(path, "/")
    counts = (F.size(parts) > 1) & F.col(path).endswith(".md") & (F.element_at(parts, -1) != "README.md") & ~F.array_contains(parts, "raw")
    return paths.filter(counts).groupBy(parts[0].alias("source")).agg(F.count(F.lit(1)).alias("n"))


def changed(new: DataFrame, old: DataFrame, key: str = "path", content: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of new to write, for their content differs or is new; keys of old that are stale)."""
    digest = lambda df: df.select(key, F.sha2(content, 256).alias("__d"))
    return new.withColumn("__d", F.sha2(content, 256)).join(digest(old), [key, "__d"], "left_anti").drop("__d"), old.select(key).join(new.select(key), key, "left_anti")


def wide_prices(wide: DataFrame) -> DataFrame:
    """ticker, day, open, high, low, close, volume of rows with a close; NaN counts as null."""
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double")).alias(c)
    return wide.select("ticker", "day", *(number(c) for c in ("open", "high", "low", "close")), F.col("volume").try_cast("long").alias("volume")).dropna(subset=["close"])
