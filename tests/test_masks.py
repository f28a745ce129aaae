"""Run-length masks against pixel sets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lensfold.functions import masks

H, W = 7, 6


def plain_counts(image):
    """Counts of a pixel matrix, down its columns."""
    out, last, n = [], 0, 0
    for x in image.T.ravel():
        if x != last:
            out, last, n = [*out, n], x, 0
        n += 1
    return [*out, n]


def pictures(n, seed):
    rng = np.random.default_rng(seed)
    out = [np.zeros((H, W), int), np.ones((H, W), int)]
    for _ in range(n):
        image = np.zeros((H, W), int)
        for _ in range(rng.integers(1, 4)):
            x, y = rng.integers(0, W), rng.integers(0, H)
            image[y : y + rng.integers(1, H + 1), x : x + rng.integers(1, W + 1)] ^= 1
        out.append(image)
    return out


def test_overlaps_crops_and_texts():
    a, b = pictures(150, 1), pictures(150, 2)[::-1]
    ca, cb = (pa.array([plain_counts(x) for x in images], pa.list_(pa.int32())) for images in (a, b))
    assert masks.intersections(ca, cb).tolist() == [int((x & y).sum()) for x, y in zip(a, b, strict=True)]
    rng = np.random.default_rng(4)
    x1, y1 = rng.integers(0, W, len(a)), rng.integers(0, H, len(a))
    x2, y2 = np.array([rng.integers(x, W + 1) for x in x1]), np.array([rng.integers(y, H + 1) for y in y1])
    got = masks.cropped(ca, np.full(len(a), H), x1, y1, x2, y2).to_pylist()
    for image, counts, box in zip(a, got, zip(x1, y1, x2, y2, strict=True), strict=True):
        window = image[box[1] : box[3], box[0] : box[2]]
        assert counts == (plain_counts(window) if window.size else [])
    assert masks.counts_from(masks.text_of(ca)).to_pylist() == ca.to_pylist()
    large = pa.array([[0, 5, 100_000, 3, 1, 70_000, 2_000_000_000], None, [], [12]], pa.list_(pa.int32()))
    assert masks.counts_from(masks.text_of(large)).to_pylist() == large.to_pylist()
    assert masks.intersections(large, large).tolist() == [70_008, 0, 0, 0]


def test_text_form():
    """Groups of five bits with 32 for more to come and 16 for the sign, from character 48 on; differences from the fourth."""
    assert masks.text_of(pa.array([[6, 1, 40, 4, 38]], pa.list_(pa.int32()))).to_pylist() == ["61X13" + chr(48 + 30)]


def test_columns(spark):
    images = pictures(40, 7)
    rows = [(k, plain_counts(x), plain_counts(images[k - 1])) for k, x in enumerate(images)] + [(900, None, None)]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>").repartition(3)
    h = F.lit(H)
    got = df.select("k", masks.rle_area(F.col("a")).alias("area"), masks.rle_iou(F.col("a"), F.col("b")).alias("iou"), masks.rle_ioa(F.col("a"), F.col("b")).alias("ioa"), masks.rle_box(F.col("a"), h).alias("box"), masks.rle_counts(masks.rle_text(F.col("a"))).alias("again"), "a")
    for r in got.collect():
        assert r.again == r.a
        if r.k == 900:
            assert r.area is None and r.iou is None and r.box is None
            continue
        a, b = images[r.k], images[r.k - 1]
        common, either = int((a & b).sum()), int((a | b).sum())
        assert r.area == a.sum() and r.iou == (common / either if either else None) and r.ioa == (common / a.sum() if a.sum() else None)
        ys, xs = np.nonzero(a)
        assert (tuple(r.box) if r.box else None) == ((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1) if len(xs) else None)
    boxes = [(x, y, w, t) for x in range(-1, W + 1) for y in range(-1, H + 1) for w in (0, 1, 2, W + 2) for t in (0, 1, 3, H + 2)]
    df = spark.createDataFrame(boxes, "x int, y int, w int, h int")
    for r in df.select("*", masks.rle_of_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(W), h).alias("c")).collect():
        image = np.zeros((H, W), int)
        image[max(0, r.y) : max(0, r.y + r.h), max(0, r.x) : max(0, r.x + r.w)] = 1
        assert r.c == plain_counts(image), r


def test_texts_are_read_together(spark, monkeypatch):
    """A batch of texts is one array, and boxes come from runs of a batch; both took some work for each mask."""
    calls, buffer = [], np.frombuffer
    monkeypatch.setattr(np, "frombuffer", lambda *a, **k: calls.append(1) or buffer(*a, **k))
    counts = pa.array([*([plain_counts(x) for x in pictures(60, 9)]), None, []], pa.list_(pa.int32()))
    text = masks.text_of(counts)
    assert masks.counts_from(text).to_pylist() == counts.to_pylist() and len(calls) == 1
    assert masks.counts_from(text.slice(5, 30)).to_pylist() == counts.to_pylist()[5:35]
    assert masks.counts_from(pa.array(["61X", "1" + chr(48 + 32), None, "", chr(48 + 32), "6"])).to_pylist() == [[6, 1], [1], None, [], [], [6]]
    plan = spark.createDataFrame([], "a array<int>").select(masks.rle_box(F.col("a"), F.lit(H)))._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan
