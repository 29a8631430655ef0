"""The life cycle of items, told by events: a state for each item that keeps up with a stream, and the same for a batch.

An event says what became of an item at a time: a status, and perhaps an error or a language. The item's status is that of its last event; error
and language are the last that were told; the last event that says DONE dates the transcript. An item that stays in a status of STUCK for longer than a
patience is put back to PENDING. All of it depends on the events alone, not on the order in which they come or on how often, so the
stream ends where the batch does, as long as no event is later than the watermark allows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Statuses that begin an attempt, and where an attempt begins and ends.
STUCK, PENDING, DONE = ("audio_downloaded", "transcribing"), "pending", "done"
PATIENCE, LATE = timedelta(hours=6), timedelta(days=1)
EVENTS = "item_id long, at timestamp, status string, error string, language string"
ITEMS = "item_id long, status string, since timestamp, error string, language string, transcribed_at timestamp"
STATE = "status string, at long, error string, error_at long, language string, language_at long, done_at long"


def settled(events: DataFrame, now: str, patience: timedelta = PATIENCE) -> DataFrame:
    """ITEMS of a batch of EVENTS at a time. Events of one time count by status, text and language, so that their order does not matter."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c]
    found = events.groupBy("item_id").agg(F.max(F.struct("at", "status")).alias("s"), last("error").alias("error"), last("language").alias("language"), F.max(F.when(F.col("status") == DONE, F.col("at"))).alias("transcribed_at"))
    until = F.col("s.at") + F.make_dt_interval(secs=F.lit(patience.total_seconds()))
    gone = F.col("s.status").isin(*STUCK) & (until <= F.lit(now).cast("timestamp"))
    return found.select("item_id", F.when(gone, PENDING).otherwise(F.col("s.status")).alias("status"), F.when(gone, until).otherwise(F.col("s.at")).alias("since"), "error", "language", "transcribed_at")


def _micros(at: pd.Timestamp | None) -> int | None:
    return None if at is None or pd.isna(at) else at.value // 1_000


class LifeCycle(StatefulProcessor):
    """Keeps each item's last events; a timer looks at what may be stuck when its patience is over."""

    def __init__(self, patience: timedelta = PATIENCE):
        self.patience = patience // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = dict(zip(("status", "at", "error", "error_at", "language", "language_at", "done_at"), self.state.get() if self.state.exists() else (None,) * 7, strict=True))
        before = dict(own)
        for frame in rows:
            for at, status, error, language in zip(frame["at"], frame["status"], frame["error"], frame["language"], strict=True):
                at, status, error, language = _micros(at), *(None if pd.isna(x) else x for x in (status, error, language))
                if own["at"] is None or (at, status or "") >= (own["at"], own["status"] or ""):
                    own["at"], own["status"] = at, status
                for name, value in (("error", error), ("language", language)):
                    if value is not None and (own[f"{name}_at"] is None or (at, value) >= (own[f"{name}_at"], own[name])):
                        own[name], own[f"{name}_at"] = value, at
                if status == DONE:
                    own["done_at"] = max(at, own["done_at"] or at)
        if own == before:
            return
        self.state.update(tuple(own.values()))
        if own["status"] in STUCK:
            self.handle.registerTimer((own["at"] + self.patience) // 1_000)
        yield self.row(key, own, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = dict(zip(("status", "at", "error", "error_at", "language", "language_at", "done_at"), self.state.get(), strict=True))
        if own["status"] in STUCK:
            yield self.row(key, own, timerValues.getCurrentWatermarkInMs())

    def row(self, key: tuple, own: dict, watermark: int) -> pd.DataFrame:
        until = own["at"] + self.patience
        gone = own["status"] in STUCK and until // 1_000 <= watermark
        stamp = lambda micros: pd.NaT if micros is None else pd.Timestamp(micros, unit="us")
        return pd.DataFrame({"item_id": [key[0]], "status": [PENDING if gone else own["status"]], "since": [stamp(until if gone else own["at"])], "error": [own["error"]], "language": [own["language"]], "transcribed_at": [stamp(own["done_at"])]})

    def close(self) -> None:
        pass


def items(events: DataFrame, patience: timedelta = PATIENCE, late: timedelta = LATE) -> DataFrame:
    """A stream of ITEMS as they change, of a stream of EVENTS. Needs spark.sql.streaming.stateStore.providerClass to be RocksDB's."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that asks for the state's schema has no shipped package
    marked = events.withWatermark("at", f"{int(late.total_seconds())} seconds")
    return marked.groupBy("item_id").transformWithStateInPandas(LifeCycle(patience), ITEMS, outputMode="Update", timeMode="EventTime")
