"""Evaluation by kind: one call from ground truth and predictions to a table of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.functions.keypoints import is_valid, pckh_similarity
from lensfold.operators import boxes, hota, mot_events, mot_metrics, pose


def _joint_pairs(gt: DataFrame, dt: DataFrame) -> DataFrame:
    distances = pose.joint_distances(gt, dt, ["seq", "frame_id"])
    return distances.select("seq", "joint", F.col("frame_id").alias("t"), "gt_id", F.col("dt_id").alias("tr_id"), pckh_similarity(F.col("dist")).alias("sim")).filter("sim > 0")


def _joints(rows: DataFrame) -> DataFrame:
    return rows.filter(is_valid(F.col("x"), F.col("y"))).select("seq", "joint", F.col("frame_id").alias("t"), "id")


def tracking(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """HOTA per joint over all sequences. ``gt(seq, frame_id, id, joint, x, y, hx1, hy1, hx2, hy2)``, ``dt(seq, frame_id, id, joint, x, y, score)``."""
    return hota.summary(hota.combine(hota.evaluate(_joint_pairs(gt, dt), _joints(gt), _joints(dt), keys=["seq", "joint"], matching="similarity"), ["joint"]), ["joint"])


def reid_tracking(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """HOTA per joint with identities that hold for all sequences: ids are persons, frames of all sequences are one series.

    Frames are told by sequence and number, as text that sorts like the two, since fragments follow that order.
    """
    frame = F.concat(F.col("seq").cast("string"), F.lit("\u0001"), F.lpad(F.col("t").cast("string"), 20, "0"))
    whole = lambda rows: rows.withColumn("t", frame)
    return hota.summary(hota.evaluate(whole(_joint_pairs(gt, dt)), whole(_joints(gt)), whole(_joints(dt)), keys=["joint"], matching="per_alpha"), ["joint"])


def mot(gt: DataFrame, dt: DataFrame, max_distance: float = 0.5) -> DataFrame:
    """CLEAR, identity and HOTA results per sequence and OVERALL of boxes ``(seq, frame_id, id, x, y, w, h)``."""
    pairs = boxes.iou_join(gt, dt, max_distance).select("seq", "frame_id", "g_id", "d_id", "d")
    log = mot_events.event_log(mot_events.frames_from_boxes(gt, dt, pairs).withColumn("seq", F.col("seq").cast("string")))
    near = boxes.iou_join(gt, dt, 1.0, touching=True).select(F.col("seq").cast("string").alias("seq"), F.col("frame_id").alias("t"), F.col("g_id").alias("gt_id"), F.col("d_id").alias("tr_id"), F.col("iou").alias("sim"))
    side = lambda rows: rows.select(F.col("seq").cast("string").alias("seq"), F.col("frame_id").alias("t"), "id")
    rows = hota.evaluate(near, side(gt), side(dt))
    every = hota.summary(rows, ["seq"]).unionByName(hota.summary(hota.combine(rows, []).withColumn("seq", F.lit("OVERALL")), ["seq"]))
    return mot_metrics.compute(log, mot_metrics.MOTCHALLENGE).join(every, "seq", "left")


def pose_estimation(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """Average precision of each joint; inputs as for :func:`tracking`."""
    return pose.keypoint_ap(gt, dt, ["seq", "frame_id"])


KINDS: dict[str, Callable[..., DataFrame]] = {"tracking": tracking, "reid_tracking": reid_tracking, "mot": mot, "pose": pose_estimation}


def evaluate(kind: str, gt: DataFrame, predictions: DataFrame, **options) -> DataFrame:
    """Results of ``predictions`` against ``gt``; ``kind`` is one of ``KINDS``."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}: one of {', '.join(KINDS)}")
    return KINDS[kind](gt, predictions, **options)
