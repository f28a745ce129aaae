"""Event-time windows; the same code runs on a stream (with a watermark) and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """``start, end, event_type, n, total`` of ``events(ts, event_type, value)``; with ``slide``, overlapping windows."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: a session ends when its user is silent for ``gap``."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_summary(events: DataFrame, path: str, checkpoint: str):
    """Per micro-batch, the counts of each type, appended below ``path``. Returns the running query."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("batch", F.lit(number))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
