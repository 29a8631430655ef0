"""The SparkSession's settings, the package for its Python workers, and working tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of the scratch() blocks that are open in this thread or task, innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("callmark_scratch", default=())


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with what the queries rely on: UTC, adaptive execution, Arrow; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.master(master).appName("callmark")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="callmark-")) / "callmark.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, Path(root.name) / path.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A local session without one gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("working tables need a folder that all executors share: set spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="callmark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/callmark"


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, within the innermost open scratch() block."""
    return f"{_OPEN.get()[-1] if _OPEN.get() else shared_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a working table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of working tables, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Working tables that are written in the block are deleted at its end; what outlives it must be written after, by kept()."""
    folder = work_dir(spark)
    before = _OPEN.set((*_OPEN.get(), folder))
    try:
        yield
    finally:
        _OPEN.reset(before)
        remove(spark, folder)


def kept(df: DataFrame) -> DataFrame:
    """materialise() outside the innermost scratch() block: the table outlives it."""
    inner = _OPEN.set(_OPEN.get()[:-1])
    try:
        return materialise(df)
    finally:
        _OPEN.reset(inner)
