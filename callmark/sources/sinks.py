"""Sinks: Markdown pages that are written only if they changed, a public copy of a subset. Tables that are kept are in store.py."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.functions import clean
from callmark.sources.markdown import read_markdown


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, path and digest of each page) of the last complete manifest below path."""
    try:
        seen = spark.read.parquet(f"{path}/_manifest")
        last = seen.agg(F.max("version")).first()[0]
        return last, seen.filter(F.col("version") == last).select("path", "digest")
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return 0, spark.createDataFrame([], "path string, digest string")


def _each_file(rows: DataFrame, root: str, write: bool) -> int:
    """Writes (path, text) below root, or removes the paths there; a number of how many. A task that runs twice does the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            n = 0
            texts = batch.column("text") if write else [None] * batch.num_rows
            for name, text in zip(batch.column("path").to_pylist(), texts, strict=True):
                target = f"{base}/{name}"
                if write:
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(target) as out:
                        out.write(text.as_py().encode())
                elif store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_pages(pages: DataFrame, root: str, remove_stale: bool = True) -> tuple[int, int]:
    """(written, removed): pages (path, text) as files below root, a URI. A manifest says what was written last time: pages of the same
    content are left alone, and pages that are no more are removed. The manifest comes last, so that a run that fails is done again."""
    spark = pages.sparkSession
    pages = pages.select("path", F.coalesce("text", F.lit("")).alias("text"))
    version, old = _manifest(spark, root)
    now = pages.select("path", F.sha2("text", 256).alias("digest"))
    stale = old.select("path").join(now.select("path"), "path", "left_anti")
    written = _each_file(pages.join(old, (pages["path"] == old["path"]) & (F.sha2("text", 256) == old["digest"]), "left_anti"), root, True)
    removed = _each_file(stale, root, False) if remove_stale else 0
    kept = now if remove_stale else now.unionByName(old.join(now.select("path"), "path", "left_anti"))
    kept.write.parquet(f"{root}/_manifest/version={version + 1}")
    return written, removed


def copy_subset(spark: SparkSession, source: str, target: str, channels: list[str] | None, first: str | None = None, last: str | None = None) -> int:
    """How many Markdown files of the allowed channels and days were copied from source to target (URIs), for target lacked them or had others."""
    files = read_markdown(spark, source)
    rel = F.regexp_replace("path", "^.*?" + _quoted(source.split("://")[-1].rstrip("/")) + "/", "")
    wanted = files.select(rel.alias("path"), "text").filter(clean.in_public_subset(F.col("path"), channels, first, last))
    return write_pages(wanted, target, remove_stale=False)[0]


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
