"""Event-time windows, for batch and stream alike (an extension: the week rollups as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def weekly(events: DataFrame, time: str = "ts") -> DataFrame:
    """user_id, week (its Monday), n, total."""
    window = F.window(F.col(time).cast("timestamp"), "7 days", "7 days", "4 days")  # days count from a Thursday
    return events.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("week"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    window = F.session_window(F.col(time).cast("timestamp"), gap)
    return events.groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def start_weekly(stream: DataFrame, table: str, checkpoint: str, late: str = "1 day", time: str = "ts") -> StreamingQuery:
    """Weeks of a stream of events into an in-memory table, all that is there now; late events are taken until the watermark passes."""
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return weekly(marked, time).writeStream.outputMode("update").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
