"""The event log of multi-object tracking: a fold over the frames of each sequence.

Input is one row a frame: ``seq, frame_id, oids, hids, dists``, with a null distance where a pair is not allowed, or ``near``
with the allowed pairs in place of ``dists``. The fold is ordered; a long sequence is cut into segments that are folded side by side, first from nothing, then again from what the
segments before them end with, until all segments have begun with the right state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lensfold.operators.assignment import assign
from lensfold.operators.groups import saved, settled

INFINITE = float("inf")
EVENTS = "seq string, frame_id long, event int, type string, oid long, hid long, d double"


@dataclass
class Accumulator:
    """State of one sequence. ``update`` returns the frame's events as (event, type, oid, hid, d)."""

    max_switch_time: float = float("inf")
    auto_id: bool = False
    matched: dict = field(default_factory=dict)  # object -> its last hypothesis
    holder: dict = field(default_factory=dict)  # hypothesis -> object it was last assigned to by the solver
    last_seen: dict = field(default_factory=dict)  # object -> last frame in which it was present
    ever_used: set = field(default_factory=set)  # hypotheses that have had an object
    last_frame: int = -1

    def update(self, oids: list, hids: list, dists: np.ndarray | list, frame_id: int | None = None, ignore: frozenset | set = frozenset()) -> tuple[int, list[tuple]]:
        """Fold one frame. ``ignore`` holds hypotheses that are no false positives if nothing comes near them."""
        if self.auto_id == (frame_id is not None):
            raise ValueError("give a frame id, unless frames are numbered automatically")
        frame = self.last_frame + 1 if frame_id is None else frame_id
        events: list[tuple] = []
        self.fold(frame, oids, hids, np.array(dists, dtype=float).reshape(len(oids) * len(hids)).tolist(), ignore, events)
        return frame, [(k, *e) for k, e in enumerate(events)]

    def fold(self, frame: int, oids: list, hids: list, dists: list, ignore: frozenset | set | list, events: list | None, near: list | None = None) -> None:
        """Fold one frame whose matrix of distances is a flat list, NaN where a pair is not allowed; ``events`` gets its rows unless it is None.

        ``near`` are the allowed pairs (row, column, distance) in their order, in place of the matrix.

        Frames hold a few rows, so this is plain Python; matrices are made only where pairs compete.
        """
        self.last_frame = frame
        n, m = len(oids), len(hids)
        near = [(k // m, k % m, d) for k, d in enumerate(dists) if -INFINITE < d < INFINITE] if near is None else near
        free_rows, free_columns = [True] * n, [True] * m
        if events is not None:
            rows, columns = {i for i, _, _ in near}, {j for _, j, _ in near}
            events.append(("RAW", None, None, None))
            events += [("RAW", oids[i], hids[j], d) for i, j, d in near]
            events += [("RAW", oids[i], None, None) for i in range(n) if i not in rows]
            events += [("RAW", None, hids[j], None) for j in range(m) if j not in columns and hids[j] not in ignore]
        matched, holder, used = self.matched, self.holder, self.ever_used
        if near:
            place = {h: j for j, h in zip(range(m - 1, -1, -1), reversed(hids), strict=True)}
            held = {(i, j): d for i, j, d in near}
            for i, o in enumerate(oids):
                j = place.get(matched[o]) if o in matched else None
                if j is not None and free_columns[j] and (i, j) in held:
                    if events is not None:
                        events.append(("MATCH", o, hids[j], held[i, j]))
                    used.add(hids[j])
                    free_rows[i] = free_columns[j] = False
            left = [p for p in near if free_rows[p[0]] and free_columns[p[1]]]
            if len(left) > 1 and (len({i for i, _, _ in left}) < len(left) or len({j for _, j, _ in left}) < len(left)):
                cost = np.full((n, m), np.nan)
                for i, j, d in left:
                    cost[i, j] = d
                left = [(i, j, held[i, j]) for i, j in assign(cost)]
            for i, j, d in left:
                o, h = oids[i], hids[j]
                had = o in matched
                switch = had and matched[o] != h and abs(frame - self.last_seen.get(o, frame)) <= self.max_switch_time
                if events is not None:
                    if switch and h not in used:
                        events.append(("ASCEND", o, h, d))
                    if h in holder and holder[h] != o:
                        if not had:
                            events.append(("MIGRATE", o, h, d))
                        events.append(("TRANSFER", o, h, d))
                    events.append(("SWITCH" if switch else "MATCH", o, h, d))
                used.add(h)
                matched[o], holder[h] = h, o
                free_rows[i] = free_columns[j] = False
        for o in oids:
            self.last_seen[o] = frame
        if events is not None:
            events += [("MISS", o, None, None) for o, free in zip(oids, free_rows, strict=True) if free]
            events += [("FP", None, h, None) for h, free in zip(hids, free_columns, strict=True) if free and h not in ignore]


def matrix(dists: list | None, n: int, m: int) -> np.ndarray:
    """Nested lists with None for forbidden pairs as an n x m matrix with NaN."""
    out = np.full((n, m), np.nan)
    for i, row in enumerate(dists if dists is not None else []):
        for j, value in enumerate(row if row is not None else []):
            out[i, j] = np.nan if value is None else value
    return out


#: What a segment passes on: for each of its objects and hypotheses, rows of this type with the id as ``oid`` and the value as ``hid``.
STATE = ("state matched", "state holder", "state used", "state seen")
PASSED = "seq string, seg long, type string, oid long, hid long"
#: Allowed pairs of a frame as a matrix with nulls, or one by one, of its own ids and in the order of its lists.
KINDS = {"dists": "array<array<double>>", "near": "array<struct<o:long,h:long,d:double>>"}
#: Events of this many frames leave a task as one batch.
BATCH = 4096


def event_log(frames: DataFrame, max_switch_time: float = float("inf"), auto_id: bool = False, segment: int = 20_000) -> DataFrame:
    """Events of ``frames(seq, frame_id, oids, hids, dists[, ignore])``, or with ``near`` for ``dists``; schema ``EVENTS``. Null lists are empty; rows without seq or frame are left out.

    Sequences of more than ``segment`` frames are cut into ranges of frame ids with about as many frames each. What a segment
    passes on is folded again only while the state of its own objects and hypotheses, as all segments before it leave it, is
    not the one it has begun with: the first of the wrong ones becomes right in each round, and usually nearly all do in two,
    since matches soon no longer depend on the start. Events are made once, when all segments begin with the right state. The
    result is that of one fold over the whole sequence.
    """
    frames = frames if "ignore" in frames.columns else frames.withColumn("ignore", F.lit(None).cast("array<long>"))
    frames = frames.select(F.col("seq").cast("string").alias("seq"), F.col("frame_id").cast("long").alias("frame_id"), "oids", "hids", pairs := "near" if "near" in frames.columns else "dists", "ignore").dropna(subset=["seq", "frame_id"])
    lists = {c: F.col(c).cast("array<long>") for c in ("oids", "hids", "ignore")} | {pairs: F.col(pairs).cast(KINDS[pairs])}
    frames = frames.withColumns(lists)
    if auto_id:
        frames = frames.withColumn("frame_id", F.row_number().over(Window.partitionBy("seq").orderBy("frame_id")).cast("long") - 1)
    frames = saved(frames)
    sizes = frames.groupBy("seq").agg(F.min("frame_id").alias("low"), (F.max("frame_id") - F.min("frame_id") + 1).alias("span"), F.count("*").alias("n"))
    long = settled(sizes.filter(F.col("n") > segment))
    if long.isEmpty():
        return _fold_segments(frames.withColumn("seg", F.lit(0).cast("long")), None, max_switch_time)
    width = F.greatest(F.floor(F.col("span") * segment / F.col("n")), F.lit(1).cast("long"))
    # A long sequence has its own share of the frames, so there are few of them.
    frames = frames.join(F.broadcast(long), "seq", "left").withColumn("seg", F.coalesce(F.floor((F.col("frame_id") - F.col("low")) / width), F.lit(0).cast("long"))).drop("low", "span", "n")
    cut = frames.join(F.broadcast(long.select("seq")), "seq", "left_semi")
    key, ids = ["seq", "seg"], ["seq", "seg", "type", "oid"]
    ends, begun = settled(_fold_segments(cut, None, max_switch_time, passed=True)), None
    while True:
        before = Window.partitionBy("seq", "type", "oid").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        start = settled(ends.select(*ids, F.last("hid", ignorenulls=True).over(before).alias("hid")).filter("hid IS NOT NULL"))
        both = start.withColumn("now", F.lit(1))
        both = both if begun is None else both.unionByName(begun.withColumn("now", F.lit(-1)))
        wrong = settled(both.groupBy(*ids, "hid").agg(F.sum("now").alias("now")).filter("now <> 0").select(*key).distinct())
        if wrong.isEmpty():
            return _fold_segments(frames, start, max_switch_time)
        begun = start
        again = _fold_segments(cut.join(wrong, key, "left_semi"), start.join(wrong, key, "left_semi"), max_switch_time, passed=True)
        ends = settled(ends.join(wrong, key, "left_anti").unionByName(again))


def _lists(column: pa.Array) -> tuple[list, list]:
    """Where each list begins in the flat values, and these."""
    return column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()


def _near_frames(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list, list, list, list]]:
    """As :func:`_frames` with no distances, but the allowed pairs as (row, column, distance)."""
    of = {name: batch.column(batch.schema.get_field_index(name)) for name in ("frame_id", "oids", "hids", "near", "ignore")}
    (o, oids), (h, hids), (g, ignore) = (_lists(of[c]) for c in ("oids", "hids", "ignore"))
    starts = of["near"].offsets.to_pylist()
    first, second, far = (of["near"].values.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("o", "h", "d"))
    for k, frame in enumerate(of["frame_id"].to_pylist()):
        own, other, near = oids[o[k] : o[k + 1]], hids[h[k] : h[k + 1]], []
        if starts[k] < starts[k + 1]:
            row, column = {x: i for i, x in enumerate(own)}, {x: j for j, x in enumerate(other)}
            near = [(row[first[i]], column[second[i]], far[i]) for i in range(starts[k], starts[k + 1]) if -INFINITE < far[i] < INFINITE]
        yield frame, own, other, [], ignore[g[k] : g[k + 1]], near


def _frames(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list, list, list, None]]:
    """``frame_id, oids, hids, dists, ignore`` of each row, the distances as one flat list with NaN for forbidden pairs."""
    of = {name: batch.column(batch.schema.get_field_index(name)) for name in ("frame_id", "oids", "hids", "dists", "ignore")}
    (o, oids), (h, hids), (g, ignore) = (_lists(of[c]) for c in ("oids", "hids", "ignore"))
    inner = of["dists"].values
    starts, values = _lists(inner)
    rows = of["dists"].offsets.to_numpy()
    wanted = np.repeat(np.diff(of["hids"].offsets.to_numpy()), np.diff(rows))
    odd = np.diff(inner.offsets.to_numpy())[rows[0] : rows[-1]] != wanted
    whole = np.diff(rows) == np.diff(of["oids"].offsets.to_numpy())
    whole[np.repeat(np.arange(len(whole)), np.diff(rows))[odd]] = False
    rows, whole = rows.tolist(), whole.tolist()
    for k, frame in enumerate(of["frame_id"].to_pylist()):
        own, other = oids[o[k] : o[k + 1]], hids[h[k] : h[k + 1]]
        dists = values[starts[rows[k]] : starts[rows[k + 1]]] if whole[k] else matrix(of["dists"][k].as_py(), len(own), len(other)).ravel().tolist()
        yield frame, own, other, dists, ignore[g[k] : g[k + 1]], None


def _fold_segments(frames: DataFrame, start: DataFrame | None, max_switch_time: float, passed: bool = False) -> DataFrame:
    """Events of all segments, or what they pass on, from the state rows in ``start(seq, seg, type, oid, hid)``.

    A segment's state comes before its frames, and these in their order through Arrow batches; only the state is held.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = frames.withColumns({"type": none("string"), "oid": none("long"), "hid": none("long")})
    rows = rows if start is None else rows.unionByName(start, allowMissingColumns=True)
    schema, each = PASSED if passed else EVENTS, _near_frames if "near" in frames.columns else _frames
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def ends(acc: Accumulator, key: tuple, objects: set, hypotheses: set) -> pa.RecordBatch:
        seen = objects if np.isfinite(max_switch_time) else ()
        out = [(STATE[0], o, acc.matched.get(o)) for o in objects] + [(STATE[1], h, acc.holder.get(h)) for h in hypotheses]
        out += [(STATE[2], h, 1 if h in acc.ever_used else None) for h in hypotheses] + [(STATE[3], o, acc.last_seen[o]) for o in seen]
        columns = ([key[0]] * len(out), [key[1]] * len(out), *zip(*out, strict=True)) if out else ([],) * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def log(keys: list, found: list[list[tuple]]) -> pa.RecordBatch:
        sizes = [len(e) for e in found]
        kinds, oids, hids, d = zip(*[e for events in found for e in events], strict=True)
        of = pa.array(np.repeat(np.arange(len(keys)), sizes))
        places = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [pa.array([k[0] for k in keys], pa.string()).take(of), pa.array([k[1] for k in keys], pa.int64()).take(of), places, kinds, oids, hids, d]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc, objects, hypotheses = None, Accumulator(max_switch_time), set(), set()
        keys: list[tuple] = []
        found: list[list[tuple]] = []
        for batch in batches:
            names = batch.schema.get_field_index
            seqs, segs, kinds, first, second = (batch.column(names(c)).to_pylist() for c in ("seq", "seg", "type", "oid", "hid"))
            for seq, seg, kind, a, b, (frame, oids, hids, dists, ignore, near) in zip(seqs, segs, kinds, first, second, each(batch), strict=True):
                if (seq, seg) != now:
                    if now is not None and passed:
                        yield ends(acc, now, objects, hypotheses)
                    now, acc, objects, hypotheses = (seq, seg), Accumulator(max_switch_time), set(), set()
                if kind is not None:
                    state = (acc.matched, acc.holder, acc.ever_used, acc.last_seen)[STATE.index(kind)]
                    state.add(a) if isinstance(state, set) else state.update({a: b})
                elif passed:
                    acc.fold(frame, oids, hids, dists, ignore, None, near)
                    objects.update(oids)
                    hypotheses.update(hids)
                else:
                    events: list[tuple] = []
                    acc.fold(frame, oids, hids, dists, ignore, events, near)
                    keys.append((seq, frame))
                    found.append(events)
                    if len(found) == BATCH:
                        yield log(keys, found)
                        keys, found = [], []
        if now is not None and passed:
            yield ends(acc, now, objects, hypotheses)
        if found:
            yield log(keys, found)

    # Nulls come first: state rows have no frame. Dealt by a hash for the reason given in fold_groups.
    return rows.repartition(F.xxhash64("seq", "seg")).sortWithinPartitions("seq", "seg", "frame_id").mapInArrow(run, schema)


def frames_from_boxes(gt: DataFrame, dt: DataFrame, pairs: DataFrame, every: DataFrame | None = None, ignored: DataFrame | None = None, matrix: bool = True) -> DataFrame:
    """One row a frame from ``gt(seq, frame_id, id)``, ``dt(seq, frame_id, id)`` and allowed ``pairs(seq, frame_id, g_id, d_id, d)``.

    Frames of either side appear, and those of ``every(seq, frame_id)`` if it is given. ``ignored(seq, frame_id, id)`` are
    detections that are no false positives if nothing comes near them. Without ``matrix`` the pairs stay ``near`` and are not
    spread over matrices.
    """
    keys = ["seq", "frame_id"]
    o = gt.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("oids"))
    h = dt.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("hids"))
    if matrix:
        p = pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("g_id", "d_id"), "d"))).alias("near"))
    else:
        p = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("g_id").alias("o"), F.col("d_id").alias("h"), "d"))).alias("near"))
    rows = o.join(h, keys, "full_outer")
    rows = rows if every is None else every.select(*keys).distinct().join(rows, keys, "left")
    rows = rows.join(p, keys, "left")
    empty = F.array().cast("array<long>")
    rows = rows.withColumn("oids", F.coalesce("oids", empty)).withColumn("hids", F.coalesce("hids", empty))
    row = lambda i: F.transform("hids", lambda j: F.try_element_at("near", F.struct(i.alias("g_id"), j.alias("d_id"))))
    out = rows.select(*keys, "oids", "hids", F.transform("oids", row).alias("dists") if matrix else "near")
    return out if ignored is None else out.join(ignored.groupBy(*keys).agg(F.collect_list("id").alias("ignore")), keys, "left")


def merge_logs(logs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several event logs as one sequence, and the mapping used.

    Frames and ids of each log are shifted beyond those of the logs before it. The mapping has ``log, frame_offset, oid_offset,
    hid_offset``. Offsets come from one maximum a log.
    """
    spark, out, offsets = logs[0].sparkSession, None, [0, 0, 0]
    rows = []
    for k, log in enumerate(logs):
        rows.append((k, *offsets))
        moved = log.select(F.lit("merged").alias("seq"), (F.col("frame_id") + offsets[0]).alias("frame_id"), "event", "type", (F.col("oid") + offsets[1]).alias("oid"), (F.col("hid") + offsets[2]).alias("hid"), "d")
        out = moved if out is None else out.unionByName(moved)
        top = log.agg(*[F.coalesce(F.max(c), F.lit(-1)) for c in ("frame_id", "oid", "hid")]).first()
        offsets = [o + t + 1 for o, t in zip(offsets, top, strict=True)]
    return out, spark.createDataFrame(rows, "log int, frame_offset long, oid_offset long, hid_offset long")


