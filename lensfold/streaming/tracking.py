"""Multi-object tracking on a stream of frames: frames wait for the watermark, then are folded in order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lensfold.operators.mot_events import EVENTS, Accumulator, matrix


def event_stream(frames: DataFrame, lateness: str = "10 seconds", max_switch_time: float = float("inf")) -> DataFrame:
    """Events of a stream ``frames(seq, ts, frame_id, oids, hids, dists)``; schema as the batch event log.

    The state of a sequence is its accumulator and the frames that the watermark has not passed. A frame is folded when the
    watermark is beyond it, in the order of frame ids; frames that come later than that are dropped.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = pickle.loads(state.get[0]) if state.exists else ({"max_switch_time": max_switch_time}, [])  # noqa: S301 own state
        acc = Accumulator(**held)
        for part in parts:
            for r in part.itertuples():
                waiting.append((int(r.at), int(r.frame_id), [int(x) for x in r.oids], [int(x) for x in r.hids], [list(x) for x in r.dists]))
        limit = state.getCurrentWatermarkMs()
        ready = sorted((w for w in waiting if w[0] <= limit), key=lambda w: w[1])
        waiting = [w for w in waiting if w[0] > limit]
        rows = []
        for _, frame, oids, hids, dists in ready:
            if frame > acc.last_frame:
                _, events = acc.update(oids, hids, matrix(dists, len(oids), len(hids)), frame)
                rows += [(key[0], frame, *e) for e in events]
        state.update((pickle.dumps((vars(acc), waiting)),))
        if waiting:
            state.setTimeoutTimestamp(min(w[0] for w in waiting) + 1 if min(w[0] for w in waiting) >= limit else limit + 1)
        if rows:
            yield pd.DataFrame(rows, columns=["seq", "frame_id", "event", "type", "oid", "hid", "d"]).astype({"oid": "Int64", "hid": "Int64", "d": "float64"})

    timed = frames.withWatermark("ts", lateness).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("seq").applyInPandasWithState(fold, EVENTS, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle_stream(sightings: DataFrame, patience: str, lateness: str = "10 seconds") -> DataFrame:
    """``seq, track_id, start, end, n``: lives of tracks in ``sightings(seq, track_id, ts)``; silence for ``patience`` ends one."""
    rows = sightings.withWatermark("ts", lateness) if sightings.isStreaming else sightings
    out = rows.groupBy(F.session_window("ts", patience).alias("w"), "seq", "track_id").agg(F.count("*").alias("n"))
    return out.select("seq", "track_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
