"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs; the table before is then deleted. All but the last return the columns of documents, and any others that docs has, whatever
their names. The mixture's training order is that of its files and of their rows; encoding takes each row's place from there,
carries it along and returns its rows in that order.

Defined results, stage by stage. Null columns: rows stay unless the stage's decision is about that column; a null text is scored,
counted and encoded as the empty text, has no near duplicates and no secrets; a null source is a source of its own; rows
without doc_id are kept by deduplication, one by one. Empty and very long texts are scored, compared, scanned and encoded
whole. Repeated rows get one score; deduplication keeps one row of an id, that of the least text; mixing repeats rows by
design. Ties go to the smaller id. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm import bpe, mixing, neardup, quality, secrets
from callmark.llm.common import remove, scratch, table, work_dir
from callmark.session import ship

LEAST_QUALITY = 0.3
SHINGLE_WORDS, LIKENESS_PERCENT = 5, 80
MOST_OWNERS_OF_A_SECRET, MOST_REPOS_OF_A_SECRET = 2, 9


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under LEAST_QUALITY go; it is fitted here on a bounded sample of labelled rows."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    ship(spark)
    return neardup.deduplicate(docs, width=SHINGLE_WORDS, percent=LIKENESS_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets, of few owners and documents, are masked; examples that were copied around stay as they are."""
    ship(spark)
    masked = secrets.redact(docs, min_owners=MOST_OWNERS_OF_A_SECRET + 1, min_repos=MOST_REPOS_OF_A_SECRET + 1)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks, in training order; a repeated document is a repeated row."""
    ship(spark)
    return mixing.training_order(docs)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and row: the number in the name of the row's file, and its place there. Rows of other origin keep the order they have."""
    part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long"), F.lit(0))
    try:
        return docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # not read from files
        number = F.monotonically_increasing_id()
        return docs.select("doc_id", "text", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit(2**33 - 1)).alias("row"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary), part and row of every row, in order of part and row; the ids decode to the bytes of the text."""
    ship(spark)
    vocabulary = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = bpe.encode(placed(docs), vocabulary, public_tokenizers.PATTERN, carry=("part", "row"))
    rows = rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "part", "row")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the mixture is dealt into as many
    return rows.repartitionById(ranges, F.least(F.col("part"), F.lit(ranges - 1)).cast("int")).sortWithinPartitions("part", "row")


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding", encode),
]
#: Neither a learned classifier nor BPE is a query in SQL; tests/llm compares each stage's rows with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = work_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
