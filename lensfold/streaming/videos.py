"""Running summaries of videos on a stream of frames, with a value state and an event-time timer for each video."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lensfold.operators.groups import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"

#: State of a video: what has been counted, and the time at which its timer stands.
TOTALS = "frames long, positive long, detections long, score double, timer long"
SUMMARY = "video string, ended boolean, frames long, positive_frames long, detections long, per_frame double, positive_rate double, mean_score double"


class VideoSummary(StatefulProcessor):
    """Adds up frames, frames with detections, detections and scores; a row every ``every`` frames, and one when a video ends.

    A video ends when no frame has come for ``silence_ms`` of event time; its state is cleared then, so state holds live
    videos only. A frame that comes after the end begins a new summary.
    """

    def __init__(self, every: int, silence_ms: int):
        self.every, self.silence = every, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 names are Spark's
        frames, positive, detections, score, timer = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.0, 0)
        part = pd.concat(list(rows)).sort_values("frame", kind="stable")
        n = part["n"].to_numpy(np.int64)
        counts = frames + np.arange(1, len(n) + 1), positive + np.cumsum(n > 0), detections + np.cumsum(n), score + np.cumsum(part["score"].to_numpy(float))
        due = np.flatnonzero(counts[0] % self.every == 0)
        last = int(part["at"].max()) + self.silence
        if last > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
            timer = last
        self.totals.update((*(int(c[-1]) for c in counts[:3]), float(counts[3][-1]), timer))
        if len(due):
            yield summary_rows(key[0], False, *(c[due] for c in counts))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.totals.exists():
            *counts, _ = self.totals.get()
            self.totals.clear()
            yield summary_rows(key[0], True, *(np.array([c]) for c in counts))

    def close(self) -> None:
        pass


def summary_rows(video: str, ended: bool, frames: np.ndarray, positive: np.ndarray, detections: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    mean = np.divide(score, detections, out=np.full(len(frames), np.nan), where=detections > 0)
    return pd.DataFrame({
        "video": video, "ended": ended, "frames": frames, "positive_frames": positive, "detections": detections,
        "per_frame": detections / frames, "positive_rate": positive / frames, "mean_score": pd.Series(mean).astype(object).where(detections > 0, None),
    })


def video_stream(frames: DataFrame, every: int = 30, silence: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """Summaries of a stream ``frames(video, frame, ts, scores array<double>)``; schema ``SUMMARY``, in append mode.

    Null or empty ``scores`` are a frame without detections; rows without video or time are left out, and times must lie after
    1970 began, where watermarks start. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). ``silence`` is in seconds.
    """
    scores = F.coalesce("scores", F.array().cast("array<double>"))
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    rows = frames.filter("video IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    rows = rows.select("video", "frame", "ts", F.unix_millis("ts").alias("at"), F.size(scores).alias("n"), total.alias("score"))
    return rows.groupBy("video").transformWithStateInPandas(VideoSummary(every, silence * 1000), SUMMARY, "Append", "EventTime")


def replayed(frames: DataFrame, every: int = 30, silence: int = 60) -> DataFrame:
    """:func:`video_stream` over a table of frames: it is written below the shared folder and read as a stream to its end, with a
    frame of no video long after the others, which ends all videos. The session's state store is as before afterwards.
    """
    spark, path = frames.sparkSession, f"{shared_folder(frames.sparkSession)}/lensfold-streams/{uuid.uuid4().hex}"
    frames = frames.select("video", "frame", F.col("ts").cast("timestamp").alias("ts"), "scores")
    frames.write.parquet(f"{path}/in/frames")
    after = spark.read.schema(frames.schema).parquet(f"{path}/in/frames").agg(F.max("ts").alias("ts"))
    after = after.select(F.lit("").alias("video"), F.lit(0).cast("long").alias("frame"), (F.col("ts") + F.make_dt_interval(secs=F.lit(float(silence + 86400)))).alias("ts"), F.lit(None).cast("array<double>").alias("scores"))
    after.write.parquet(f"{path}/in/zz-after")
    store = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frames.schema).parquet(f"{path}/in/*")
        out = video_stream(stream, every, silence).filter("video <> ''")
        query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, store) if store else spark.conf.unset(STORE)
    return spark.read.schema(out.schema).parquet(f"{path}/out")
