"""The stored table: what a merge writes, what readers see, commits that die, counters that are replayed."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callmark.operators import counters, incremental
from callmark.session import work_dir
from callmark.sources.store import Conflict, Store

SCHEMA = "id long, v string, at timestamp_ntz"


def frame(spark, *rows):
    return spark.createDataFrame([(i, v, dt.datetime(2024, 1, day)) for i, v, day in rows], SCHEMA)


def latest(a, b):
    return incremental.upsert(a, b, ["id"], "at")


def shown(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


@pytest.fixture
def store(spark):
    made = Store.create(spark, work_dir(spark), frame(spark, (1, "a", 1)).schema, ["id"], 8)
    made.merge(frame(spark, *((i, f"v{i}", 2) for i in range(40))), latest)
    return made


def files(store):
    return set(store.read().inputFiles())


def test_merge_writes_what_changes(spark, store):
    before, number = files(store), store.manifest().number
    changed = store.merge(frame(spark, (3, "new", 3), (4, "old", 1), (99, "more", 1)), latest)
    assert 1 <= len(changed) <= 2
    assert shown(store.read()) == sorted([(i, "new" if i == 3 else f"v{i}") for i in range(40)] + [(99, "more")])
    assert shown(store.read(number)) == sorted((i, f"v{i}") for i in range(40))
    assert len(before & files(store)) >= len(before) * (8 - len(changed)) / 8 - 4
    now, number = files(store), store.manifest().number
    assert store.merge(frame(spark, (3, "new", 3), (99, "more", 1)), latest) == [] == store.merge(frame(spark, (4, "older", 1)), latest)
    assert store.merge(frame(spark, (1, "x", 1)).limit(0), latest) == []
    assert files(store) == now and store.manifest().number == number and len(store._names("data")) <= 2


def test_merge_kinds(spark, store):
    store.merge(frame(spark, (1, "again", 9), (50, "absent", 1)), lambda a, b: incremental.insert_absent(a, b, ["id"]))
    assert dict(shown(store.read()))[1] == "v1" and dict(shown(store.read()))[50] == "absent"
    store.replace(store.read().filter("id < 5"))
    assert shown(store.read()) == [(i, f"v{i}") for i in range(5)]
    store.replace(store.read().limit(0))
    assert shown(store.read()) == [] and Store(spark, store.path).manifest().keys == ["id"]
    odd = spark.createDataFrame([(None, None, None), (1, None, None), (1, None, None)], SCHEMA)
    store.merge(odd, lambda a, b: a.unionByName(b))
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, odd.collect()))


def test_commit_that_dies(spark, store, monkeypatch):
    """A run that ends between its rows and its manifest changes nothing that a reader sees; the next commit removes what it left."""
    want, number = shown(store.read()), store.manifest().number
    reader = store.read()
    with monkeypatch.context() as m:
        m.setattr(Store, "_add", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.merge(frame(spark, (7, "lost", 5)), latest)
    left = set(store._names("data"))
    assert shown(Store(spark, store.path).read()) == want == shown(reader) and store.manifest().number == number and len(left) == 2
    store.merge(frame(spark, (8, "kept", 5)), latest)
    assert dict(shown(store.read()))[8] == "kept" and dict(shown(store.read()))[7] == "v7" and shown(reader) == want
    assert len(left & set(store._names("data"))) == 1


def test_two_writers(spark, store, monkeypatch):
    stale = store.manifest()
    store.merge(frame(spark, (1, "first", 5)), latest)
    with monkeypatch.context() as m:
        m.setattr(Store, "manifest", lambda self, number=None: stale)
        with pytest.raises(Conflict):
            store.merge(frame(spark, (1, "second", 6)), latest)
    assert dict(shown(store.read()))[1] == "first"
    assert not [n for n in store._names("_manifests") if n.startswith(".")]


def test_old_states_go(spark, store):
    first = store.manifest().number
    for day in range(3, 6):
        store.merge(frame(spark, (1, f"d{day}", day)), latest)
    with pytest.raises(LookupError):
        store.read(first)
    assert dict(shown(store.read(store.manifest().number - 1)))[1] == "d4"


def test_counters(spark):
    measures = {"n": ("count", F.lit(True)), "big": ("count", F.col("x") > 5), "total": ("sum", F.col("x")), "least": ("min", F.col("x")), "most": ("max", F.col("x"))}
    kinds = {n: k for n, (k, _) in measures.items()}
    rows = spark.createDataFrame([(i % 7 if i % 5 else None, i * 13 % 11) for i in range(200)], "k int, x long")
    states = lambda df: counters.states(df, ["k"], measures)
    store = Store.create(spark, work_dir(spark), states(rows).schema, ["k"], 4)
    parts = [rows.filter(F.pmod("x", F.lit(3)) == i) for i in range(3)]
    assert [counters.add(store, states(parts[i]), kinds, "s", i) for i in (0, 1, 1, 0, 2)] == [True, True, False, False, True]
    want = Counter(map(tuple, states(rows).collect()))
    assert Counter(map(tuple, store.read().collect())) == want
    assert counters.reconciled(store, states(rows), kinds).count() == 0
    counters.add(store, states(parts[0]), kinds)  # counted twice: drift
    drift = counters.reconciled(store, states(rows), kinds)
    assert drift.count() > 0 and drift.filter("stored_n <= counted_n").count() == 0
    assert Counter(map(tuple, store.read().collect())) == want and store.manifest().notes == {"s": 2}


def test_counters_of_a_stream(spark, tmp_path):
    """A stream of files counted batch by batch; a second run with a lost checkpoint replays all batches, and counts nothing twice."""
    measures = {"n": ("count", F.lit(True)), "last_at": ("max", F.col("at"))}
    for i in range(3):
        frame(spark, *((k % 3, "x", i + 1) for k in range(10 + i))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = frame(spark, (1, "x", 1)).schema
    store = Store.create(spark, work_dir(spark), counters.states(spark.createDataFrame([], schema), ["id"], measures).schema, ["id"], 4)
    for run in ("a", "b"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = counters.count_stream(stream, store, measures, "files", f"{tmp_path}/{run}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted((r["id"], r["n"]) for r in store.read().collect()) == [(0, 12), (1, 11), (2, 10)]
    assert store.manifest().notes == {"files": 2}
