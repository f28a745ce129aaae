"""Joins of boxes and points inside frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensfold.functions.geometry import Box, area, box, box_polygon_area, ioa, iou, polygon_area, simple_rings, xywh_to_xyxy

KEYS = ["seq", "frame_id"]


def frame_pairs(gt: DataFrame, dt: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Every ground-truth row with every detection of its frame; columns other than the keys get ``g_`` and ``d_`` before their names."""
    g = gt.select(*keys, *[F.col(c).alias(f"g_{c}") for c in gt.columns if c not in keys])
    d = dt.select(*keys, *[F.col(c).alias(f"d_{c}") for c in dt.columns if c not in keys])
    return g.join(d, keys)


def all_frames(gt: DataFrame, dt: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Frames that either side has."""
    return gt.select(*keys).union(dt.select(*keys)).distinct()


def pair_boxes(prefix_a: str = "g_", prefix_b: str = "d_") -> tuple[Box, Box]:
    return xywh_to_xyxy(box(prefix_a)), xywh_to_xyxy(box(prefix_b))


def overlapping(a: Box, b: Box) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def iou_join(gt: DataFrame, dt: DataFrame, max_distance: float = 0.5, keys: list[str] = KEYS, touching: bool = False) -> DataFrame:
    """Pairs of a frame with 1 - IoU at most ``max_distance``, as ``iou`` and ``d``.

    Below 1, or with ``touching``, boxes that do not overlap are dropped before the division.
    """
    a, b = pair_boxes()
    pairs = frame_pairs(gt, dt, keys)
    pairs = pairs.filter(overlapping(a, b)) if max_distance < 1 or touching else pairs
    pairs = pairs.withColumn("iou", iou(a, b)).withColumn("d", 1 - F.col("iou"))
    # Each filter on a computed column computes it once more; a distance is never above 1.
    return pairs.filter(F.col("d") <= max_distance) if max_distance < 1 else pairs


def ioa_join(gt: DataFrame, dt: DataFrame, least: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """Pairs in which the ground-truth box covers ``least`` of the detection, as ``ioa``."""
    a, b = pair_boxes()
    return frame_pairs(gt, dt, keys).filter(overlapping(a, b)).withColumn("ioa", ioa(b, a)).filter(F.col("ioa") >= least)


def l2_join(gt: DataFrame, dt: DataFrame, max_squared: float, keys: list[str] = KEYS) -> DataFrame:
    """Pairs of a frame whose top-left corners are at most that far apart, squared, as ``d2``."""
    d2 = (F.col("g_x") - F.col("d_x")) ** 2 + (F.col("g_y") - F.col("d_y")) ** 2
    return frame_pairs(gt, dt, keys).withColumn("d2", d2).filter(F.col("d2") <= max_squared)


def normalised_similarity(pairs: DataFrame, keys: list[str], row: str, column: str, sim: str) -> DataFrame:
    """Add ``align``: sim / (sum over its row + sum over its column - sim)."""
    rows, columns = F.sum(sim).over(Window.partitionBy(*keys, row)), F.sum(sim).over(Window.partitionBy(*keys, column))
    return pairs.withColumn("align", F.try_divide(F.col(sim), rows + columns - F.col(sim)))


def ignore_candidates(boxes: DataFrame, regions: DataFrame, keys: list[str], limit: float = 0.1) -> DataFrame:
    """``keys, id`` of the ``boxes(keys, id, x, y, w, h)`` whose overlap with one of ``regions(keys, region, xs, ys)`` exceeds ``limit``.

    A region may cross itself: it is split into simple parts first, and the overlap is the common area of all parts over the
    sum of their unions with the box. Regions without a part are left out.
    """
    parts = regions.select(*keys, "region", F.explode(simple_rings(F.col("xs"), F.col("ys"))).alias("part"))
    parts = parts.select(*keys, "region", F.col("part.xs").alias("xs"), F.col("part.ys").alias("ys"))
    bounds = {"x1": F.array_min("xs"), "y1": F.array_min("ys"), "x2": F.array_max("xs"), "y2": F.array_max("ys")}
    parts = parts.withColumns({"area": polygon_area(F.col("xs"), F.col("ys")), **bounds})
    own = xywh_to_xyxy(box())
    met = boxes.select(*keys, "id", "x", "y", "w", "h").join(parts, keys)
    near = overlapping(own, tuple(F.col(c) for c in bounds))  # a fold over edges is only made where there is something in common
    met = met.withColumn("common", F.when(near, box_polygon_area(own, F.col("xs"), F.col("ys"))).otherwise(0.0)).withColumn("either", F.col("area") + area(own) - F.col("common"))
    per = met.groupBy(*keys, "id", "region").agg((F.sum("common") / F.sum("either")).alias("overlap"))
    return per.filter(F.col("overlap") > limit).select(*keys, "id").distinct()
