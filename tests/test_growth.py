"""What makes work grow faster than the tables: rows moved twice, work repeated for equal inputs, folds over all that has been."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lensfold.functions import geometry
from lensfold.operators import assignment, boxes, detection, hota, mot_events, tracker
from lensfold.plans import tables
from lensfold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """Hash exchanges that the plan makes, those it uses again left out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_frames_are_dealt_once(spark):
    """Boxes meet, and frames are grouped, where the ids inside frames were made."""
    gt = tables.ground_truth(spark, SF)
    assert exchanges(boxes.frame_pairs(gt, tables.detections(gt)).groupBy("seq", "frame_id", "g_id").count()) == 1


def test_equal_rings_are_split_once(monkeypatch):
    calls, split = [], geometry.split_ring
    monkeypatch.setattr(geometry, "split_ring", lambda ring: calls.append(1) or split(ring))
    xs, ys = pa.array([[0.0, 4.0, 4.0, 0.0]] * 50 + [None]), pa.array([[0.0, 4.0, 0.0, 4.0]] * 51)
    got = geometry._simple_rings.func(xs, ys).to_pylist()
    assert len(calls) == 1 and [len(r) for r in got] == [2] * 50 + [0]


def test_no_matrix_without_competition(monkeypatch):
    """Pairs that share neither object nor hypothesis need no assignment."""
    monkeypatch.setattr(mot_events, "assign", lambda cost: pytest.fail("assigned"))
    acc = mot_events.Accumulator()
    _, events = acc.update([1, 2], [7, 8], [[0.1, np.nan], [np.nan, 0.2]], 0)
    assert [e[1:4] for e in events if e[1] == "MATCH"] == [("MATCH", 1, 7), ("MATCH", 2, 8)]


def test_dead_tracks_are_not_held():
    t = tracker.Tracker(patience=1)
    found = [t.step(k, [k], {}, {})[0] for k in range(50)]
    assert found == [(k, k) for k in range(50)] and len(t.tracks) <= 3


def test_track_over_batches(spark):
    """A sequence that is cut into Arrow batches gives what one fold over it gives."""
    rng = np.random.default_rng(3)
    rows = [(s, f, 10 * f + d, [float(x) for x in rng.normal(size=2)] if d else None) for s in ("a", "b") for f in range(60) for d in range(int(rng.integers(0, 4)))]
    ids = {(s, f): [r[2] for r in rows if r[:2] == (s, f)] for s in ("a", "b") for f in range(60)}
    near = [(s, a, b, float(rng.uniform())) for s in ("a", "b") for f in range(1, 60) for a in ids[s, f - 1] for b in ids[s, f]]
    want = []
    for s in ("a", "b"):
        own = tracker.Tracker(patience=2)
        for f in range(60):
            if ids[s, f]:
                affinity = {(a, b): v for q, a, b, v in near if q == s}
                want += [(s, f, *x) for x in own.step(f, sorted(ids[s, f]), affinity, {r[2]: r[3] for r in rows if r[0] == s})]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        detections = spark.createDataFrame(rows, "seq string, frame_id long, det_id long, feature array<double>").orderBy(F.rand(1))
        got = tracker.track(detections, spark.createDataFrame(near, "seq string, a long, b long, value double"), patience=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(want)


def test_matching_is_shared(monkeypatch):
    """Thresholds with the same pairs, and areas that ignore the same boxes, are matched once."""
    calls, greedy = [], detection._greedy
    monkeypatch.setattr(detection, "_greedy", lambda *a: calls.append(1) or greedy(*a))
    group = {"id": np.array([1, 1]), "is_gt": np.array([True, False]), "crowd": np.array([False, False]), "score": np.array([0.0, 0.9])}
    group |= {"x": np.array([0.0, 0.0]), "y": np.array([0.0, 0.0]), "w": np.array([50.0, 50.0]), "h": np.array([50.0, 50.0])}
    _, outcomes = detection._outcomes(group, detection.IOUS, tuple(detection.AREAS))
    assert len(calls) == 2 and [o[0] for o in outcomes] == [1] * 10 + [-1] * 10 + [1] * 10 + [-1] * 10


def test_hota_rows_are_not_multiplied(spark):
    """A match is one row for all thresholds until it is counted, also where matchings differ between thresholds; runs go on through Arrow batches."""
    rng = np.random.default_rng(5)
    pairs = [("s", f, g, int(rng.integers(0, 3)), float(rng.uniform(0.01, 1))) for f in range(200) for g in range(2)]
    pairs = list({p[:4]: p for p in pairs}.values())
    df = spark.createDataFrame(pairs, "seq string, t long, gt_id long, tr_id long, sim double")
    assert hota.matches_per_alpha(df, ["seq"]).count() <= len(pairs)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sums = hota.run_sums(df, ["seq"])
        assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()
        got = sums.groupBy("alpha", "gt_id", "tr_id").agg(F.sum("m"), F.sum("squares")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for alpha in hota.ALPHAS:
        for g in range(2):
            own = [p[3] for p in pairs if p[2] == g and p[4] >= alpha - hota.EPS]
            for d, run in itertools.groupby(own):
                n = len(list(run))
                m, squares = want.get((alpha, g, d), (0, 0))
                want[alpha, g, d] = m + n, squares + n * n
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == want


def test_groups_are_assigned_together(monkeypatch):
    """Frames whose rows do not compete need no solver, and all groups get what each gets alone."""
    rng = np.random.default_rng(7)
    monkeypatch.setitem(assignment._SOLVERS, "shortest_paths", lambda cost: pytest.fail("solved"))
    starts, rows = np.arange(0, 60, 2), np.arange(60) % 2
    assert len(assignment.best_edges(starts, rows, 1 - rows, np.ones(60))) == 60
    monkeypatch.undo()
    group = np.sort(rng.integers(0, 40, 300))
    _, keep = np.unique(np.stack((group, i := rng.integers(0, 4, 300), j := rng.integers(0, 5, 300))), axis=1, return_index=True)
    group, i, j, cost = group[keep], i[keep], j[keep], np.where(rng.uniform(size=len(keep)) < 0.1, np.nan, rng.normal(size=len(keep)))
    order = np.argsort(group, kind="stable")
    group, i, j, cost = (x[order] for x in (group, i, j, cost))
    got = assignment.chosen_edges(np.flatnonzero(np.append(True, group[1:] != group[:-1])), i, j, cost)
    want = []
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        r, c = np.unique(i[own]), np.unique(j[own])
        matrix = np.full((len(r), len(c)), np.nan)
        matrix[np.searchsorted(r, i[own]), np.searchsorted(c, j[own])] = cost[own]
        want += [(int(g), int(r[a]), int(c[b])) for a, b in assignment.assign(matrix)]
    assert sorted(zip(group[got].tolist(), i[got].tolist(), j[got].tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("name", ["hota_fields", "new_poses", "keypoint_similarity", "mutual_best_match"])
def test_line_items_are_moved_once(spark, name):
    """Uses of the boxes in a plan share the exchange of the line items, but where one keeps rows without an order and one does not; then frames stay."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the tables are small, the plan is to be that of large ones
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "ReusedExchange" not in line]
    assert sum("l_orderkey" in line for line in moved) == (2 if name in ("hota_fields", "new_poses") else 1)
    assert sum("frame_id" in line for line in moved) == 0


def test_line_items_of_a_task_are_bounded(spark, monkeypatch):
    """Larger tables are dealt to more tasks, not to as many larger ones, and all uses still share one exchange."""
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    gt = tables.ground_truth(spark, SF)
    parts = gt.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 1000
    test_line_items_are_moved_once(spark, "mutual_best_match")


def test_pairs_of_frames_are_not_spread(spark):
    """The event log of boxes takes the allowed pairs as they are; matrices, which it was made of before, give the same events."""
    gt = tables.ground_truth(spark, SF).filter("frame_id < 300")
    dt = tables.detections(gt)
    pairs = boxes.iou_join(gt, dt, 0.5).select("seq", "frame_id", "g_id", "d_id", "d")
    whole, near = (mot_events.frames_from_boxes(gt, dt, pairs, matrix=m) for m in (True, False))
    assert "map_from_entries" not in near._jdf.queryExecution().optimizedPlan().toString()
    want, got = (sorted(map(str, mot_events.event_log(frames, segment=5).collect())) for frames in (whole, near))
    assert got == want and len(got) > 300


def test_similarity_by_batches(spark):
    """Derived joints give what arrays of joints give, null for a null number, and no function over arrays runs for each pair."""
    from lensfold.functions import keypoints

    rows = spark.createDataFrame([(0.0, 1.0, 3.5, 2.0), (5.0, 2.0, 5.0, 40.0), (None, 0.0, 1.0, 9.0)], "x double, y double, u double, area double")
    row_of = lambda x, y: (x[:, None] + np.arange(17), y[:, None] + np.zeros(17))
    joints = lambda x, y: F.array(*[F.struct((x + k).alias("x"), y.alias("y"), F.lit(1.0).alias("score")) for k in range(17)])
    x, y, u, area = (F.col(c) for c in rows.columns)
    got = rows.select(keypoints.oks_of_derived([x, y], [u, y], area, row_of), keypoints.oks(joints(x, y), joints(u, y), area)).collect()
    assert [r[0] for r in got[:2]] == pytest.approx([r[1] for r in got[:2]]) and got[2][0] is None and got[1][0] == 1
    assert "zip_with" not in QUERIES["keypoint_similarity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
