"""A stored table that merges change: rows in buckets by key, copied on write, and a numbered manifest for each state.

A manifest says for every bucket which folder holds its rows. A merge reads and writes the buckets that its rows fall into, keeps of what it
wrote the buckets that came out different, and ends by adding the next manifest under a name that must be free. So a reader sees one
state or the next and never a gap; a run that dies leaves folders that no manifest names, which the next commit removes; of two
writers at a time one fails; and a merge that changes nothing leaves everything as it was. What the last KEPT manifests name stays for their readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table, files of a bucket at most, states that are kept.
BUCKETS, FILES, KEPT = 64, 4, 2


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass
class Manifest:
    number: int
    schema: StructType
    keys: list[str]
    buckets: dict[int, str] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)
    n_buckets: int = BUCKETS


class Store:
    """The table below a path; made by create(), later opened by its path alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], n_buckets: int = BUCKETS) -> Store:
        store = cls(spark, path)
        if store.manifest() is None:
            store._add(Manifest(0, schema, list(keys), n_buckets=n_buckets))
        return store

    def _names(self, folder: str) -> list[str]:
        at = self._fs_path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The last one, or that of a number; null if there is none."""
        known = [n for n in self._names("_manifests") if n.endswith(".json")]
        name = known[-1] if number is None and known else f"{number:012d}.json" if number is not None else None
        if name not in known:
            return None
        stream = self._fs.open(self._fs_path(f"{self.path}/_manifests/{name}"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(told["number"], StructType.fromJson(told["schema"]), told["keys"], {int(b): f for b, f in told["buckets"].items()}, told["notes"], told["n_buckets"])

    def _add(self, m: Manifest) -> None:
        """Writes the manifest aside and gives it its name, which must be free: this is the commit."""
        aside = f"{self.path}/_manifests/.{uuid.uuid4().hex}"
        out = self._fs.create(self._fs_path(aside), False)
        out.write(bytearray(json.dumps({"number": m.number, "schema": m.schema.jsonValue(), "keys": m.keys, "buckets": m.buckets, "notes": m.notes, "n_buckets": m.n_buckets}).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs_path(aside), self._fs_path(f"{self.path}/_manifests/{m.number:012d}.json"), none)
        except Exception as e:
            self._fs.delete(self._fs_path(aside), False)
            raise Conflict(f"state {m.number} is there already") from e

    def _read(self, m: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(m.buckets.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(m.schema).parquet(*folders) if folders else self.spark.createDataFrame([], m.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of the last state, or of one that is still kept."""
        m = self.manifest(number)
        if m is None:
            raise LookupError(f"{self.path} has no state {'' if number is None else number}")
        return self._read(m)

    def _bucketed(self, rows: DataFrame, m: Manifest) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*m.keys), F.lit(m.n_buckets)).cast("int"))

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], notes: dict[str, int] | None = None) -> list[int]:
        """Puts how(old, new) in place of the old rows of the buckets that new falls into; the numbers of the buckets that changed. how gives rows of
        these buckets only, and those that it does not change as they were. notes are kept with the state, and are a new state even alone."""
        m = self.manifest()
        touched = sorted(r["bucket"] for r in self._bucketed(new, m).select("bucket").distinct().collect())  # at most n_buckets
        return self._put(m, touched, how(self._read(m, touched), new) if touched else None, notes or {})

    def replace(self, rows: DataFrame, notes: dict[str, int] | None = None) -> list[int]:
        """The table has these rows and no others; buckets that come out as they were are left alone."""
        m = self.manifest()
        return self._put(m, range(m.n_buckets), rows, notes or {})

    def _put(self, m: Manifest, touched: Sequence[int], rows: DataFrame | None, notes: dict[str, int]) -> list[int]:
        folder, changed, written = uuid.uuid4().hex, [], set()
        if rows is not None:
            columns = m.schema.fieldNames()
            dealt = self._bucketed(rows.select(*columns), m)
            # a bucket's rows go to several files, dealt by what they hold; a bucket without rows has no folder
            dealt.repartition("bucket", F.pmod(F.xxhash64(*columns), F.lit(FILES))).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            written = {int(n.split("=")[1]) for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
            state = Manifest(m.number, m.schema, m.keys, dict.fromkeys(written, folder), n_buckets=m.n_buckets)
            before, after = self._digests(m, touched), self._digests(state, touched)
            changed = [b for b in touched if before.get(b) != after.get(b)]
        notes = m.notes | notes
        if changed or notes != m.notes:
            kept = {b: f for b, f in m.buckets.items() if b not in changed}
            self._add(Manifest(m.number + 1, m.schema, m.keys, kept | {b: folder for b in changed if b in written}, notes, m.n_buckets))
        self.clean()
        return changed

    def _digests(self, m: Manifest, buckets: Sequence[int]) -> dict[int, tuple]:
        """Number of rows of each bucket and sums of their hashes, which tell two states of it apart."""
        columns = m.schema.fieldNames()
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
        rows = self._bucketed(self._read(m, buckets), m).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"))
        return {r["bucket"]: (r["n"], r["a"], r["b"]) for r in rows.collect()}

    def clean(self) -> None:
        """Removes manifests but the last KEPT, and folders and buckets that none of these names."""
        numbers = [n for n in self._names("_manifests") if n.endswith(".json")]
        for old in numbers[:-KEPT]:
            self._fs.delete(self._fs_path(f"{self.path}/_manifests/{old}"), False)
        named = {f"{f}/bucket={b}" for n in numbers[-KEPT:] for b, f in self.manifest(int(n.split(".")[0])).buckets.items()}
        folders = {f.split("/")[0] for f in named}
        for folder in self._names("data"):
            if folder not in folders:
                self._fs.delete(self._fs_path(f"{self.path}/data/{folder}"), True)
                continue
            for bucket in self._names(f"data/{folder}"):
                if bucket.startswith("bucket=") and f"{folder}/{bucket}" not in named:
                    self._fs.delete(self._fs_path(f"{self.path}/data/{folder}/{bucket}"), True)
