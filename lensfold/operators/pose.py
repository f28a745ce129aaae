"""Keypoint matching, average precision, and suppression by object keypoint similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensfold.functions.geometry import point_in_polygon
from lensfold.functions.keypoints import head_size, is_valid, oks, pckh_distance
from lensfold.operators.groups import settled

#: 15 joints by body part, in the order in which they are stored.
PARTS = {"Head": (12, 13, 14), "Shou": (8, 9), "Elb": (7, 10), "Wri": (6, 11), "Hip": (2, 3), "Knee": (1, 4), "Ankl": (0, 5)}


def _met(a: DataFrame, b: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """``a`` and ``b`` joined on ``keys`` and ``same``, of which only ``keys`` decide where rows are dealt: frames that are dealt already are not moved."""
    named = {c: f"_{c}" for c in same}
    agree = F.lit(True)
    for c, other in named.items():
        agree = agree & F.col(c).between(F.col(other), F.col(other))  # an equality would be a key of the join
    return a.join(b.withColumnsRenamed(named), keys).filter(agree).drop(*named.values())


def joint_distances(gt: DataFrame, dt: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gt_id, dt_id, joint, dist, score`` for joints that both poses have.

    ``gt(keys, id, joint, x, y, hx1, hy1, hx2, hy2)`` carries its head box, ``dt(keys, id, joint, x, y, score)`` its confidence.
    """
    g = gt.filter(is_valid(F.col("x"), F.col("y"))).select(*keys, F.col("id").alias("gt_id"), "joint", F.col("x").alias("gx"), F.col("y").alias("gy"), head_size(F.col("hx1"), F.col("hy1"), F.col("hx2"), F.col("hy2")).alias("head"))
    d = dt.filter(is_valid(F.col("x"), F.col("y"))).select(*keys, F.col("id").alias("dt_id"), "joint", F.col("x").alias("dx"), F.col("y").alias("dy"), "score")
    both = _met(g, d, keys, ["joint"])
    return both.select(*keys, "gt_id", "dt_id", "joint", pckh_distance(F.col("gx"), F.col("gy"), F.col("dx"), F.col("dy"), F.col("head")).alias("dist"), "score")


def match_poses(distances: DataFrame, gt_sizes: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """``keys, gt_id, dt_id``: for each detection its best ground truth, then for each ground truth the best of these.

    The score is the share of the ground truth's joints (``gt_sizes(keys, gt_id, n)``) within ``limit``; none at 0. Ties go to
    the smaller id.
    """
    hit = distances.groupBy(*keys, "gt_id", "dt_id").agg(F.count_if(F.col("dist") <= limit).alias("hits"))
    scored = _met(hit.filter("hits > 0"), gt_sizes, keys, ["gt_id"]).withColumn("pck", F.col("hits") / F.col("n")).filter("pck > 0")
    best = lambda by, other: F.row_number().over(Window.partitionBy(*keys, by).orderBy(F.desc("pck"), other))
    one = scored.withColumn("k", best("dt_id", "gt_id")).filter("k = 1")
    return one.withColumn("k", best("gt_id", "dt_id")).filter("k = 1").select(*keys, "gt_id", "dt_id")


def precision_recall(scored: DataFrame, totals: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """Running ``precision`` and ``recall`` of ``scored(keys, id, score, positive)`` by falling score; ``totals(keys, n)`` are the positives to find.

    A class may have most of the rows: rows are dealt by ranges of the score, counted inside a range, and shifted by the
    counts of the ranges before. ``part`` is a row's range.
    """
    order = [F.desc("score"), tie]
    dealt = settled(scored.join(totals, keys).repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    hit = F.col("positive").cast("int")
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "part").agg(F.count("*").alias("rows"), F.sum(hit).alias("hits"))
    before = sizes.select(*keys, "part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("rows", "hits")])
    inside = Window.partitionBy(*keys, "part").orderBy(*order)
    rows = dealt.withColumn("place", F.row_number().over(inside)).withColumn("hits", F.sum(hit).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, [*keys, "part"]).withColumn("place", F.col("place") + F.col("rows_before")).withColumn("hits", F.col("hits") + F.col("hits_before")).drop("rows_before", "hits_before")
    return rows.withColumn("precision", F.col("hits") / F.col("place")).withColumn("recall", F.col("hits") / F.greatest(F.col("n"), F.lit(1)))


def with_envelope(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``envelope``, the best precision from a row on, and ``below``, the recall before it."""
    later = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    tops = curve.groupBy(*keys, "part").agg(F.max("precision").alias("top")).select(*keys, "part", F.max("top").over(later).alias("top"))
    own = F.max("precision").over(Window.partitionBy(*keys, "part").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("own", own).join(tops, [*keys, "part"])
    below = (F.col("hits") - F.col("positive").cast("int")) / F.greatest(F.col("n"), F.lit(1))
    return rows.withColumn("envelope", F.greatest("own", "top")).withColumn("below", below)


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ap, precision, recall``: area under the precision envelope, and the values at the curve's end."""
    rows = with_envelope(curve, keys)
    return rows.groupBy(*keys).agg(F.sum((F.col("recall") - F.col("below")) * F.col("envelope")).alias("ap"), F.max_by("precision", "place").alias("precision"), F.max_by("recall", "place").alias("recall"))


def interpolated_ap(curve: DataFrame, keys: list[str], points: int = 101) -> DataFrame:
    """``keys, ap``: mean precision envelope at evenly spaced recalls, 0 where a recall is not reached."""
    place = lambda recall: F.floor((recall + 1e-12) * (points - 1)).cast("int")
    # A row answers for the recalls between the row before it and its own; the first one for recall 0 too.
    lo = F.when(F.col("place") == 1, F.lit(0)).otherwise(place(F.col("below")) + 1)
    rows = with_envelope(curve, keys).withColumn("lo", lo).withColumn("hi", place(F.col("recall")))
    return rows.groupBy(*keys).agg((F.sum(F.when(F.col("hi") >= F.col("lo"), F.col("envelope") * (F.col("hi") - F.col("lo") + 1))) / points).alias("ap"))


def part_means(per_joint: DataFrame, value: str = "ap") -> DataFrame:
    """One row of the mean over each body part's joints, and over all joints as ``Total``."""
    parts = [F.avg(F.when(F.col("joint").isin(*joints), F.col(value))).alias(name) for name, joints in PARTS.items()]
    return per_joint.agg(*parts, F.avg(value).alias("Total"))


def keypoint_ap(gt: DataFrame, dt: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """``joint, ap, precision, recall``: a joint of a matched detection within ``limit`` is a hit; all other detected joints are false."""
    distances = joint_distances(gt, dt, keys)
    sizes = gt.filter(is_valid(F.col("x"), F.col("y"))).groupBy(*keys, F.col("id").alias("gt_id")).agg(F.count("*").alias("n"))
    matched = match_poses(distances, sizes, keys, limit)
    hits = _met(distances.filter(F.col("dist") <= limit), matched, keys, ["gt_id", "dt_id"]).select(*keys, F.col("dt_id").alias("id"), "joint", F.lit(True).alias("positive"))
    scored = dt.filter(is_valid(F.col("x"), F.col("y"))).join(hits, [*keys, "id", "joint"], "left").fillna(False, ["positive"])
    scored = scored.select("joint", F.concat_ws("/", *keys, "id").alias("id"), "score", "positive")
    totals = gt.filter(is_valid(F.col("x"), F.col("y"))).groupBy("joint").agg(F.count("*").alias("n"))
    return average_precision(precision_recall(scored, totals, ["joint"]), ["joint"])


def greedy_keep(rows: DataFrame, keys: list[str], payload: list[str], score: str, clash: callable, tie: str = "id") -> DataFrame:
    """Greedy suppression inside each group: by falling score a row stays unless it ``clash``-es with one that stays.

    The fold runs in the JVM over the group's sorted array; group by what bounds it, such as an image.
    """
    own = F.struct((-F.col(score)).alias("_order"), F.col(tie).alias("_tie"), *[F.col(c) for c in payload])
    sorted_rows = F.array_sort(F.collect_list(own))
    grouped = rows.groupBy(*keys).agg(sorted_rows.alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: clash(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return grouped.select(*keys, F.posexplode(kept).alias("place", "row")).select(*keys, F.col("place"), *[F.col(f"row.{c}").alias(c) for c in payload])


def pose_nms(poses: DataFrame, keys: list[str], threshold: float = 0.5, least_score: float | None = None) -> DataFrame:
    """Suppress poses ``(keys, id, joints, area)`` whose similarity to a better one (by mean joint score) reaches the threshold."""
    mean = F.aggregate(F.transform("joints", lambda j: j["score"]), F.lit(0.0), lambda s, x: s + x) / F.size("joints")
    rows = poses.withColumn("score", mean)
    clash = lambda k, b: oks(k["joints"], b["joints"], (k["area"] + b["area"]) / 2, least_score=least_score) >= threshold
    return greedy_keep(rows, keys, ["id", "joints", "area", "score"], "score", clash)


def new_poses(candidates: DataFrame, existing: DataFrame, keys: list[str], threshold: float, least_score: float | None = None) -> DataFrame:
    """Candidates whose similarity to every existing pose of their frame is at most ``threshold``."""
    old = existing.select(*keys, F.col("joints").alias("old_joints"), F.col("area").alias("old_area"))
    old = old.withColumnsRenamed({c: f"_{c}" for c in keys})
    near = oks(F.col("old_joints"), F.col("joints"), F.col("old_area"), least_score=least_score) > threshold
    for c in keys:
        near = near & (F.col(c) == F.col(f"_{c}"))
    return candidates.join(old, near, "left_anti")  # one pass over the frames; a pose is compared no further once one is near


def least_joints(joints: Column, n: int) -> Column:
    return F.size(F.filter(joints, lambda j: is_valid(j["x"], j["y"]))) >= n


def outside_regions(poses: DataFrame, keys: list[str]) -> DataFrame:
    """Poses ``(keys, joints, regions_x, regions_y)`` with the joints inside a region set to 0, and without those that lose all.

    Regions are arrays of polygons of the pose's frame; null or empty regions cover nothing.
    """
    regions = F.arrays_zip(F.col("regions_x").alias("xs"), F.col("regions_y").alias("ys"))
    covered = lambda j: F.exists(regions, lambda r: point_in_polygon(j["x"], j["y"], r["xs"], r["ys"]))
    zero = F.lit(0.0)
    cleared = F.transform("joints", lambda j: F.when(F.coalesce(covered(j), F.lit(False)), F.struct(zero.alias("x"), zero.alias("y"), zero.alias("score"))).otherwise(F.struct(j["x"].alias("x"), j["y"].alias("y"), j["score"].alias("score"))))
    return poses.withColumn("joints", cleared).filter(least_joints(F.col("joints"), 1)).drop("regions_x", "regions_y")
