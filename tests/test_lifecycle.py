"""Life cycles of items: the stream ends where the batch does, whatever the order of events, and timers reset what is stuck."""

import datetime as dt
import random

import pytest

from callmark.streaming import lifecycle as lc

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def run(spark, folder, name, late):
    """The last row of each item, of all batches, and how many rows there were."""
    found, rows = {}, []

    def take(batch, _):
        for r in batch.collect():
            rows.append(tuple(r))
            found[r["item_id"]] = tuple(r)

    stream = spark.readStream.schema(lc.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    query = lc.items(stream, late=late).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{folder}/{name}-at").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return found, rows


def land(spark, folder, name, *batches):
    for events in batches:
        spark.createDataFrame(events, lc.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_stream_equals_batch(spark, rocks, tmp_path):
    r = random.Random(1)
    events = [(i, START + dt.timedelta(minutes=r.randint(0, 2_000)), r.choice(["pending", "audio_downloaded", "transcribing", "done", "error", None]), r.choice([None, "e1", "e2"]), r.choice([None, "en", "zh"])) for i in range(40) for _ in range(r.randint(1, 5))]
    events += r.sample(events, 30)  # told twice
    r.shuffle(events)
    late, end = dt.timedelta(days=3), START + dt.timedelta(days=9)
    last = [(999, end + dt.timedelta(minutes=k), "pending", None, None) for k in range(2)]  # they move the watermark on
    land(spark, tmp_path, "in", events[0::3], events[1::3], events[2::3], last[:1], last[1:])
    found, rows = run(spark, tmp_path, "in", late)
    want = {x["item_id"]: tuple(x) for x in lc.settled(spark.createDataFrame(events + last, lc.EVENTS), str(last[1][1] - late)).collect()}
    assert found == want and len(want) == 41
    assert sum(x[1] == "pending" for x in want.values()) > 5
    waiting = [x for x in rows if x[1] in lc.STUCK]
    assert waiting and all(found[x[0]][1] not in lc.STUCK for x in waiting)


def test_late_end_after_reset(spark, rocks, tmp_path):
    """An attempt that was put back, and of which then the end is told after all, is done."""
    at = lambda h: START + dt.timedelta(hours=h)
    land(spark, tmp_path, "in", [(1, at(0), "transcribing", None, "en")], [(2, at(30), "pending", None, None)], [(2, at(31), "pending", None, None)], [(1, at(5), "done", None, None)], [(2, at(32), "pending", "e", None)])
    found, rows = run(spark, tmp_path, "in", dt.timedelta(hours=20 + 8))
    assert found[1] == (1, "done", at(5), None, "en", at(5)) and found[2][1:4] == ("pending", at(32), "e")
    assert (1, "transcribing", at(0), None, "en", None) in rows
