"""Regions that cross themselves, against rasters and known areas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.functions import geometry
from lensfold.operators import boxes

BOW_TIE = [(0, 0), (4, 4), (4, 0), (0, 4)]
TOUCHING = [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]  # two triangles that meet in a point
EIGHT = [(0, 0), (2, 0), (2, 4), (4, 4), (4, 2), (0, 2)]


@pytest.mark.parametrize(("ring", "areas"), [(BOW_TIE, [4, 4]), (TOUCHING, [4, 4]), (EIGHT, [4, 4]), ([(0, 0), (4, 0), (4, 3)], [6]), ([(0, 0), (1, 1), (2, 2)], []), ([(0, 0), (3, 0), (3, 0), (3, 3), (0, 3)], [9])])
def test_split_ring(ring, areas):
    assert sorted(geometry.ring_area(r) for r in geometry.split_ring(np.array(ring, float))) == pytest.approx(areas)


def raster(ring, box, n=400):
    """Area by even-odd points of a fine grid over [0, 4] x [0, 4]."""
    c = (np.arange(n) + 0.5) * 4 / n
    x, y = np.meshgrid(c, c)
    inside = np.zeros_like(x, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return float((inside & (x > box[0]) & (x < box[2]) & (y > box[1]) & (y < box[3])).sum()) * (4 / n) ** 2


def test_common_area(spark):
    """Random rings, most of which cross themselves once, and random boxes; the parts' common areas add up to the raster's."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(40):
        ring = [tuple(map(float, p)) for p in rng.uniform(0, 4, (4, 2))]
        x, y = rng.uniform(-1, 4, 2)
        rows.append((k, [p[0] for p in ring], [p[1] for p in ring], float(x), float(y), float(x + rng.uniform(0.1, 4)), float(y + rng.uniform(0.1, 4))))
    df = spark.createDataFrame([*rows, (99, None, [1.0], 0.0, 0.0, 1.0, 1.0)], "k int, xs array<double>, ys array<double>, x1 double, y1 double, x2 double, y2 double")
    parts = df.select("*", F.explode(geometry.simple_rings(F.col("xs"), F.col("ys"))).alias("p"))
    area = geometry.box_polygon_area(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("p.xs"), F.col("p.ys"))
    got = {r.k: r.a for r in parts.groupBy("k").agg(F.sum(area).alias("a")).collect()}
    assert set(got) == set(range(40))
    for k, xs, ys, *box in rows:
        assert got[k] == pytest.approx(raster(list(zip(xs, ys, strict=True)), box), abs=0.03)


def test_ignore_candidates(spark):
    regions = spark.createDataFrame([("s", 0, [float(p[0]) for p in BOW_TIE], [float(p[1]) for p in BOW_TIE]), ("s", 1, [10.0, 12.0, 12.0, 10.0], [10.0, 10.0, 12.0, 12.0]), ("s", 2, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0])], "seq string, region int, xs array<double>, ys array<double>")
    rows = [("s", 1, 0.0, 0.0, 4.0, 4.0), ("s", 2, 10.0, 10.0, 2.0, 2.0), ("s", 3, 11.9, 11.9, 2.0, 2.0), ("s", 4, 50.0, 0.0, 1.0, 1.0), ("t", 5, 0.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "seq string, id int, x double, y double, w double, h double")
    # the first: 8 of the parts' areas, over unions of 16 and 16
    assert {r.id for r in boxes.ignore_candidates(df, regions, ["seq"], 0.24).collect()} == {1, 2}
    assert {r.id for r in boxes.ignore_candidates(df, regions, ["seq"], 0.26).collect()} == {2}
