"""Tracking from affinities: greedy association, re-association by appearance, and the life of tracks.

Tracks arise in the fold, so affinities are given between detections of different frames, and a track is met through its last
detection.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lensfold.operators.assignment import assign

TRACKED = "seq string, frame_id long, det_id long, track_id long"


@dataclass
class Track:
    number: int
    detections: list = field(default_factory=list)  # (frame, detection)
    features: deque = field(default_factory=deque)
    inactive: int = 0
    dead: bool = False

    @property
    def active(self) -> bool:
        return not self.dead and self.inactive == 0


@dataclass
class Tracker:
    """State of one sequence.

    A frame's detections take, in their order, the free active track with most affinity (``greedy``). What is left is
    compared with inactive tracks by the dot product of features and assigned optimally (if ``reid``). The rest start
    tracks. Tracks without detection grow inactive, and die after ``patience`` frames; those shorter than ``shortest``
    detections die at once.
    """

    min_affinity: float = 0.3
    min_similarity: float = 0.5
    patience: int = 7
    shortest: int = 1
    memory: int = 5
    reid: bool = True
    tracks: list[Track] = field(default_factory=list)  # those that are not dead
    started: int = 0

    def greedy(self, detections: list, affinity: dict) -> dict:
        """detection -> track: each detection in turn takes the free active track with most affinity; ties by track."""
        free = {t.number: t for t in self.tracks if t.active and t.detections} if affinity else {}
        out = {}
        for d in detections:
            values = {n: affinity.get((t.detections[-1][1], d), 0.0) for n, t in free.items()}
            fit = [n for n, v in values.items() if v > 0 and v >= self.min_affinity]
            if fit:
                out[d] = free.pop(min(fit, key=lambda n: (-values[n], n)))
        return out

    def reassociate(self, detections: list, features: dict) -> dict:
        """detection -> inactive track, by the mean of the track's remembered features."""
        idle = [t for t in self.tracks if not t.dead and t.inactive > 0 and t.features]
        known = [d for d in detections if features.get(d) is not None]
        if not (self.reid and idle and known):
            return {}
        sim = np.array([[float(np.dot(np.mean(t.features, axis=0), features[d])) for d in known] for t in idle])
        return {known[j]: idle[i] for i, j in assign(np.where(sim > self.min_similarity, -sim, np.nan))}

    def step(self, frame: int, detections: list, affinity: dict, features: dict) -> list[tuple[int, int]]:
        """(detection, track) of one frame."""
        found = self.greedy(detections, affinity)
        found |= self.reassociate([d for d in detections if d not in found], features)
        for d in detections:
            if d not in found:
                found[d] = Track(self.started)
                self.started += 1
                self.tracks.append(found[d])
        seen = set()
        for d in detections:
            track = found[d]
            track.detections.append((frame, d))
            track.inactive = 0
            seen.add(track.number)
            if features.get(d) is not None:
                track.features.append(np.asarray(features[d], float))
                while len(track.features) > self.memory:
                    track.features.popleft()
        for t in self.tracks:
            if not t.dead and t.number not in seen:
                t.inactive += 1
                t.dead = t.inactive > self.patience or len(t.detections) < self.shortest
        self.tracks = [t for t in self.tracks if not t.dead]
        return [(d, found[d].number) for d in detections]


def track(detections: DataFrame, affinities: DataFrame, **parameters) -> DataFrame:
    """``seq, frame_id, det_id, track_id`` of ``detections(seq, frame_id, det_id, feature)`` and ``affinities(seq, a, b, value)``.

    ``value`` is the affinity of detection ``a`` of an earlier frame and ``b``. A sequence is one ordered fold, through Arrow
    batches of its frames; a detection brings its affinities along, and only living tracks are held.
    """
    schema = to_arrow_schema(_parse_datatype_string(TRACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, seq, frame, out = Tracker(**parameters), None, None, []
        present: list[int] = []
        affinity: dict[tuple[int, int], float] = {}
        features: dict = {}

        def close() -> None:
            out.extend((seq, frame, d, n) for d, n in tracker.step(frame, present, affinity, features))

        for batch in batches:
            seqs, frames, own, feature, near = (batch.column(batch.schema.get_field_index(c)) for c in ("seq", "frame_id", "det_id", "feature", "near"))
            starts, a, value = near.offsets.to_pylist(), near.values.field("a").to_pylist(), near.values.field("value").to_pylist()
            plain = feature.null_count == len(feature)
            for k, (s, f, d) in enumerate(zip(seqs.to_pylist(), frames.to_pylist(), own.to_pylist(), strict=True)):
                if s != seq or f != frame:
                    if present:
                        close()
                    tracker = tracker if s == seq else Tracker(**parameters)
                    seq, frame, present, affinity, features = s, f, [], {}, {}
                present.append(d)
                affinity.update({(a[i], d): value[i] for i in range(starts[k], starts[k + 1])})
                features[d] = None if plain else feature[k].as_py()
            yield from _tracked(out, schema)
            out.clear()
        if present:
            close()
        yield from _tracked(out, schema)

    pairs = affinities.groupBy(F.col("seq").alias("_seq"), F.col("b").alias("_b")).agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("value").cast("double").alias("value"))).alias("near"))
    kinds = {"seq": F.col("seq").cast("string"), "frame_id": F.col("frame_id").cast("long"), "det_id": F.col("det_id").cast("long")}
    met = (F.col("seq") == F.col("_seq")) & (F.col("det_id") == F.col("_b"))
    rows = detections.join(pairs, met, "left").filter("seq IS NOT NULL AND frame_id IS NOT NULL").withColumns(kinds).select(*kinds, "feature", "near")
    return rows.repartition(F.xxhash64("seq")).sortWithinPartitions("seq", "frame_id", "det_id").mapInArrow(run, TRACKED)


def _tracked(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fused_affinity(pairs: DataFrame, pose_threshold: float = 0.8, corr_threshold: float = 0.1, min_joints: int = 3) -> DataFrame:
    """Add ``pose_held, value, votes, chosen`` to ``pairs(seq, frame_id, track_id, det_id, box, pose, corr, n_joints)``.

    ``box`` is the share of a track's points inside the detection's box, ``corr`` a sum over ``n_joints`` joints. A pair with
    ``box`` above ``corr_threshold`` has a value, the pose score plus the correlation per joint. A track chooses its pair of
    most value (ties: smaller detection) if the pose is above ``pose_threshold`` and the correlation above
    ``corr_threshold`` times ``min_joints``. ``votes`` counts box, correlation and pose where they speak for the pair.
    Missing scores are 0.
    """
    for c in ("box", "pose", "corr"):
        pairs = pairs.withColumn(c, F.coalesce(c, F.lit(0.0)))
    near = F.col("box") > corr_threshold
    per_joint = F.col("corr") / F.greatest(F.coalesce("n_joints", F.lit(0)), F.lit(1))
    rows = pairs.withColumn("pose_held", F.when(near, F.col("pose")).otherwise(0.0)).withColumn("value", F.when(near, F.col("pose") + per_joint))
    rows = rows.withColumn("votes", (F.col("box") > 0).cast("int") + (F.col("corr") > 0).cast("int") + (F.col("pose") > pose_threshold).cast("int"))
    first = F.row_number().over(Window.partitionBy("seq", "frame_id", "track_id").orderBy(F.desc_nulls_last("value"), "det_id")) == 1
    passes = (F.col("value") > 0) & (F.col("pose") > pose_threshold) & (F.col("corr") > corr_threshold * min_joints)
    return rows.withColumn("chosen", first & F.coalesce(passes, F.lit(False)))


def associated(scored: DataFrame) -> DataFrame:
    """``seq, frame_id, det_id, track_id``: each detection with the best of the tracks that chose it, among pairs of ``fused_affinity``.

    A track chooses one detection, so this equals the greedy pass over a frame's detections.
    """
    order = Window.partitionBy("seq", "frame_id", "det_id").orderBy(F.desc("value"), "track_id")
    return scored.filter("chosen").withColumn("k", F.row_number().over(order)).filter("k = 1").select("seq", "frame_id", "det_id", "track_id")


def duplicates(scored: DataFrame, threshold: float) -> DataFrame:
    """``seq, frame_id, det_id, track_id``: detections without a track that look like a second sight of one (the smallest such track).

    Of a track that more than one detection has votes for, pose and correlation are divided by those of the track's own
    detection: the one it chose, or the frame's first. A ratio to nothing is 0; the two ratios together exceed ``threshold``.
    """
    track = Window.partitionBy("seq", "frame_id", "track_id")
    rows = scored.withColumn("first", F.min("det_id").over(Window.partitionBy("seq", "frame_id")))
    rows = rows.withColumn("any", F.max("chosen").over(track)).withColumn("n", F.sum((F.col("votes") > 0).cast("int")).over(track))
    own = F.when(F.col("any"), F.col("chosen")).otherwise(F.col("det_id") == F.col("first"))
    ratio = F.lit(0.0)
    for c in ("pose_held", "corr"):
        best = F.max(F.when(own, F.col(c))).over(track)
        ratio = ratio + F.when(best > 0, F.col(c) / best).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("taken", F.max("chosen").over(Window.partitionBy("seq", "frame_id", "det_id")))
    found = rows.filter((F.col("votes") > 0) & (F.col("n") > 1) & (F.col("ratio") > threshold) & ~F.col("taken"))
    return found.groupBy("seq", "frame_id", "det_id").agg(F.min("track_id").alias("track_id"))


def long_tracks(rows: DataFrame, least: int, least_joints: int = 0, joints: Column | None = None) -> DataFrame:
    """Rows of tracks with ``least`` detections or more, of those with enough joints, under dense track numbers per sequence."""
    used = rows if joints is None else rows.filter(joints >= least_joints)
    kept = used.withColumn("n", F.count("*").over(Window.partitionBy("seq", "track_id"))).filter(F.col("n") >= least).drop("n")
    return kept.withColumn("track_id", (F.dense_rank().over(Window.partitionBy("seq").orderBy("track_id")) - 1).cast("long"))


def propagated(poses: DataFrame) -> DataFrame:
    """Each frame's poses as candidates for the next frame of their sequence: ``frame_id`` is the frame they are proposed for."""
    frames = poses.select("seq", "frame_id").distinct().withColumn("next", F.lead("frame_id").over(Window.partitionBy("seq").orderBy("frame_id")))
    moved = poses.join(frames, ["seq", "frame_id"]).filter("next is not null")
    return moved.withColumn("frame_id", F.col("next")).drop("next")


def lifecycle(sightings: DataFrame, patience: int) -> DataFrame:
    """``seq, track_id, life, first, last, n`` of ``sightings(seq, track_id, frame_id)``: a gap longer than ``patience`` ends a life."""
    order = Window.partitionBy("seq", "track_id").orderBy("frame_id")
    new = F.when(F.col("frame_id") - F.lag("frame_id").over(order) > patience + 1, 1).otherwise(0)
    rows = sightings.withColumn("new", new).withColumn("life", F.sum("new").over(order))
    return rows.groupBy("seq", "track_id", "life").agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("n"))
