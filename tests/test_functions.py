"""Expressions against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.functions import geometry, keypoints, text, vectors
from lensfold.operators import boxes, detection, pose, retrieval


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*values):
    return tuple(F.lit(float(v)) for v in values)


def test_squared_distance_join(spark):
    a = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (2, 2), (3, 2)])], "frame_id long, id long, x double, y double").withColumn("seq", F.lit(0))
    b = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 1)])], "frame_id long, id long, x double, y double").withColumn("seq", F.lit(0))
    got = {(r.g_id, r.d_id): r.d2 for r in boxes.l2_join(a, b, 100).collect()}
    assert got == {(0, 0): 5, (0, 1): 1, (1, 0): 8, (1, 1): 2, (2, 0): 13, (2, 1): 5}
    assert boxes.l2_join(a, b, 5).count() == 4


def test_iou_distances(spark):
    own = geometry.xywh_to_xyxy(lits(0, 0, 1, 2))
    row = one(spark, *[1 - geometry.iou(own, geometry.xywh_to_xyxy(lits(*b))) for b in ((0, 0, 1, 2), (0, 0, 1, 1), (1, 1, 1, 1), (0.5, 0, 1, 1), (0, 1, 1, 1))])
    assert list(row) == pytest.approx([0, 0.5, 1, 0.8, 0.5])


def test_polygons(spark):
    xs, ys = F.array(*lits(0, 4, 4, 0)), F.array(*lits(0, 0, 4, 4))
    diamond = F.array(*lits(2, 4, 2, 0)), F.array(*lits(0, 2, 4, 2))
    row = one(spark, geometry.polygon_area(xs, ys), geometry.box_polygon_area(lits(1, 1, 3, 3), xs, ys), geometry.box_polygon_area(lits(0, 0, 2, 2), *diamond), geometry.box_polygon_area(lits(9, 9, 10, 10), xs, ys), geometry.point_in_polygon(*lits(2, 1), *diamond), geometry.point_in_polygon(*lits(0.5, 0.5), *diamond))
    assert list(row) == [16, 4, 2, 0, True, False]


def test_transforms(spark):
    m = geometry.affine_from_box(F.lit(10.0), F.lit(20.0), F.lit(40.0), 80, 80)
    x, y = geometry.affine_apply(F.lit(15.0), F.lit(18.0), m)
    bx, by = geometry.affine_apply(x, y, geometry.affine_inverse(m))
    corners = geometry.rotated_corners(*lits(5, 5, 4, 2, math.pi / 2))
    b = geometry.unletterbox(lits(0, 140, 640, 500), F.lit(1280.0), F.lit(720.0), 640, 640)
    row = one(spark, x, y, bx, by, F.array_max(corners[0]), F.array_max(corners[1]), *b)
    assert list(row) == pytest.approx([50, 36, 15, 18, 6, 7, 0, 0, 1280, 720])


def test_masks(spark):
    rows = F.array(*[F.array(*[F.lit(v) for v in r]) for r in ((0, 0, 0, 0), (0, 1, 1, 0), (0, 0, 1, 0))])
    row = one(spark, geometry.mask_box(rows), geometry.mask_iou(F.array(*[F.lit(v) for v in (1, 1, 0, 0)]), F.array(*[F.lit(v) for v in (0, 1, 1, 0)])))
    assert tuple(row.c0) == (1, 1, 2, 2) and row.c1 == pytest.approx(1 / 3)


def test_vectors(spark):
    v = F.array(*lits(3, 4))
    row = one(spark, vectors.norm(v), vectors.l2_normalise(v), vectors.expectation(F.array(*lits(0, 0, 0))), vectors.argmax(F.array(*lits(1, 5, 5))), vectors.memory_update(F.array(*lits(1, 0)), F.array(F.array(*lits(0, 1))), 0.5), vectors.quiet_divide(F.lit(1.0), F.lit(0.0)), vectors.repaired_score(F.lit(-0.25)))
    assert row.c0 == 5 and row.c1 == [0.6, 0.8] and row.c2 == pytest.approx(1) and row.c3 == 1
    assert row.c4 == pytest.approx([math.sqrt(0.5)] * 2) and row.c5 is None and row.c6 == 0.75


def test_oks(spark):
    joints = lambda shift: F.array(*[F.struct(F.lit(1.0 + k + shift).alias("x"), F.lit(2.0).alias("y"), F.lit(0.9).alias("score")) for k in range(17)])
    row = one(spark, keypoints.oks(joints(0), joints(3), F.lit(100.0)), keypoints.oks(joints(0), joints(0), F.lit(100.0), least_score=0.95), keypoints.n_valid(joints(0)), keypoints.pckh_similarity(F.lit(0.25)))
    assert row.c0 == pytest.approx(np.mean([math.exp(-9 / (2 * (2 * s) ** 2 * 100)) for s in keypoints.SIGMAS_17]))
    assert row.c1 == 0 and row.c2 == 17 and row.c3 == pytest.approx(1 - 0.25 / 0.5001)


def test_names(spark):
    rows = spark.createDataFrame([("0002_c1s1_000451_03.jpg",), ("-1_c3s2.jpg",), ("17_frame.jpg",), ("junk.jpg",), ("12_3_c4_0099.png",)], "n string")
    got = [tuple(r) for r in rows.select(*text.pid_and_cam(F.col("n")), text.renamed(F.col("n"))).collect()]
    assert got == [(2, 1, "0002_c1s1_000451_03.jpg"), (-1, 3, "-1_c3s2.jpg"), (17, 0, "17_frame.jpg"), (-1, -1, "junk.jpg"), (12, 0, "12_c4_f0099.jpg")]
    row = one(spark, *text.id_and_camera(F.lit("5_7_c2_1")), *text.id_and_camera(F.lit("5_7_c2_1"), anchored=False), text.duration_seconds(F.lit("0:02:33.6")), text.clock(F.lit("3/7/2024"), F.lit("14:34:6")).cast("string"), text.clean_attribute(F.lit('"walKING"')), text.replace_setting(F.lit("a: 1\n  epochs: 3"), "epochs", "9"))
    assert list(row) == [None, None, 7, 2, pytest.approx(153.6), "2024-03-07 14:34:06", "Walking", "a: 1\n  epochs: 9"]


def test_nms(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 2, 0, 20.0, 20.0, 30.0, 30.0, 0.7), (1, 3, 1, 0.0, 0.0, 10.0, 10.0, 0.6)]
    df = spark.createDataFrame(rows, "image_id long, id long, label int, x1 double, y1 double, x2 double, y2 double, score double").withColumn("v", F.array(F.lit(1.0)))
    assert sorted(r.id for r in detection.nms(df, 0.5).collect()) == [0, 2, 3]
    assert sorted(r.id for r in detection.nms(df, 0.5, by_class=False).collect()) == [0, 2]
    kept = detection.nms(df, 0.5, keep=1, carry=("v",)).collect()
    assert [(r.id, r.v) for r in kept] == [(0, [1.0])]
    turned = df.select("image_id", "id", F.array("x1", "x2", "x2", "x1").alias("xs"), F.array("y1", "y1", "y2", "y2").alias("ys"), "score")
    assert sorted(r.id for r in detection.rotated_nms(turned, 0.5).collect()) == [0, 2]


def test_coco(spark):
    gt = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0), (1, 0, 2, 50.0, 0.0, 10.0, 10.0, 1)], "image_id long, label int, id long, x double, y double, w double, h double, crowd int")
    dt = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 2, 50.0, 0.0, 5.0, 5.0, 0.8), (1, 0, 3, 90.0, 0.0, 5.0, 5.0, 0.7)], "image_id long, label int, id long, x double, y double, w double, h double, score double")
    found = {r.id: r.positive for r in detection.coco_matches(gt, dt, (0.5,)).collect()}
    assert found == {1: True, 2: None, 3: False}
    assert detection.coco_ap(gt, dt, (0.5,)).first().ap == pytest.approx(1.0)


def test_voc_and_interpolated_ap(spark):
    rows = spark.createDataFrame([(0, i, s, p) for i, (s, p) in enumerate([(0.9, True), (0.8, False), (0.7, True), (0.6, False)])], "k int, id long, score double, positive boolean")
    curve = pose.precision_recall(rows, spark.createDataFrame([(0, 3)], "k int, n long"), ["k"])
    assert pose.average_precision(curve, ["k"]).first().ap == pytest.approx(1 / 3 + 1 / 3 * 2 / 3)
    want = sum(max([p for p, r in ((1, 1 / 3), (0.5, 1 / 3), (2 / 3, 2 / 3), (0.5, 2 / 3)) if r >= k / 100 - 1e-12], default=0) for k in range(101)) / 101
    assert pose.interpolated_ap(curve, ["k"]).first().ap == pytest.approx(want)


def test_distances_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 5)))], "id long, v array<double>")
    whole = {(r.q, r.g): (r.d, r["rank"]) for r in retrieval.knn(rows, rows, 4).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    blocks = retrieval.ranked(retrieval.distances(rows, rows, nearest=4, query_block=7)).filter("rank <= 4")
    assert {(r.q, r.g): (r.d, r["rank"]) for r in blocks.collect()} == whole
    assert len(whole) == 160 and all(q != g for q, g in whole)


def test_top_k_and_losses(spark):
    logits = spark.createDataFrame([(1, 0, [2.0, 1.0]), (1, 1, [0.0, 3.0])], "image_id long, query int, logits array<double>")
    top = [(r.label, r.query) for r in detection.top_scores(logits, 3).orderBy("rank").collect()]
    assert top == [(1, 1), (0, 0), (1, 0)]
    shape = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.2, 0.2, 100, 200)], "image_id long, query int, cx double, cy double, w double, h double, orig_w int, orig_h int")
    row = detection.decoded_boxes(detection.top_scores(logits, 1), shape).first()
    assert (row.x1, row.y1, row.x2, row.y2) == pytest.approx((40, 80, 60, 120))
