"""Evaluation by kind on inputs whose result is known."""

import pytest
from pyspark.sql import functions as F

from lensfold.operators import pose
from lensfold.plans import api


@pytest.fixture(scope="module")
def perfect(spark):
    rows = [("s", f, i, j, 10.0 * i + j + 1, 5.0 + j, 0.0, 0.0, 3.0, 4.0) for f in range(3) for i in range(2) for j in (0, 12)]
    gt = spark.createDataFrame(rows, "seq string, frame_id long, id long, joint int, x double, y double, hx1 double, hy1 double, hx2 double, hy2 double")
    return gt, gt.select("seq", "frame_id", "id", "joint", "x", "y").withColumn("score", F.lit(0.9))


def test_perfect_poses(perfect):
    gt, dt = perfect
    for kind in ("tracking", "reid_tracking"):
        rows = api.evaluate(kind, gt, dt).collect()
        assert len(rows) == 2 and all(r.hota == pytest.approx(1) and r.loca == pytest.approx(1) for r in rows)
    assert all(r.ap == pytest.approx(1) for r in api.evaluate("pose", gt, dt).collect())


def test_half_of_the_boxes(spark):
    gt = spark.createDataFrame([("s", f, i, 50.0 * i, 0.0, 10.0, 10.0) for f in range(4) for i in range(2)], "seq string, frame_id long, id long, x double, y double, w double, h double")
    rows = {r.seq: r for r in api.evaluate("mot", gt, gt.filter("id = 0")).collect()}
    for name in ("s", "OVERALL"):
        assert rows[name].mota == pytest.approx(0.5) and rows[name].idf1 == pytest.approx(2 / 3) and rows[name].deta == pytest.approx(0.5) and rows[name].assa == pytest.approx(1)


def test_unknown_kind(perfect):
    with pytest.raises(ValueError, match="unknown kind"):
        api.evaluate("other", *perfect)


def test_joints_in_regions(spark):
    poses = spark.createDataFrame([(1, [(1.0, 1.0, 0.9), (9.0, 9.0, 0.8)], [[0.0, 2.0, 2.0, 0.0]], [[0.0, 0.0, 2.0, 2.0]]), (2, [(1.0, 1.0, 0.9)], [[0.0, 2.0, 2.0, 0.0]], [[0.0, 0.0, 2.0, 2.0]]), (3, [(1.0, 1.0, 0.9)], None, None)], "id long, joints array<struct<x:double,y:double,score:double>>, regions_x array<array<double>>, regions_y array<array<double>>")
    got = {r.id: [tuple(j) for j in r.joints] for r in pose.outside_regions(poses, ["id"]).collect()}
    assert got == {1: [(0.0, 0.0, 0.0), (9.0, 9.0, 0.8)], 3: [(1.0, 1.0, 0.9)]}
