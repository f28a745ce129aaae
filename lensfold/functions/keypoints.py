"""Keypoint similarities. Joints are arrays of structs (x, y, score)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Per-joint falloff of object keypoint similarity for 17 joints.
SIGMAS_17 = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)


def oks(a: Column, b: Column, area: Column, sigmas: tuple[float, ...] = SIGMAS_17, least_score: float | None = None) -> Column:
    """Mean over joints of exp(-d^2 / (2 s^2 area)), s = 2 sigma; only joints of ``b`` above ``least_score`` count, if it is given."""
    variances = F.array(*[F.lit((2 * s) ** 2) for s in sigmas])
    d2 = F.zip_with(a, b, lambda p, q: F.struct(((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2).alias("d"), q["score"].alias("score")))
    e = F.zip_with(d2, variances, lambda d, v: F.when(F.lit(True) if least_score is None else d["score"] > least_score, F.exp(-d["d"] / (2 * v * (area + F.lit(2.220446049250313e-16))))))
    used = F.filter(e, lambda x: x.isNotNull())
    return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda s, x: s + x) / F.size(used)).otherwise(F.lit(0.0))


def oks_of_derived(a: list[Column], b: list[Column], area: Column, joints: Callable[..., tuple[np.ndarray, np.ndarray]], sigmas: tuple[float, ...] = SIGMAS_17) -> Column:
    """As :func:`oks`, of poses that ``joints`` derives from the numbers ``a`` and ``b`` inside tasks; null if one of these is null.

    ``joints`` takes an array a column and gives x and y, a row a pose and a column a joint. Whole Arrow batches are compared at
    a time, and what is moved to Python are the numbers, not the joints of each pair.
    """
    scale, n = 2 * (2 * np.array(sigmas)) ** 2, len(a)

    @F.arrow_udf(DoubleType())
    def similarity(*numbers: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in numbers])
        *numbers, area = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in numbers)
        (ax, ay), (bx, by) = joints(*numbers[:n]), joints(*numbers[n:])
        near = np.exp(-((ax - bx) ** 2 + (ay - by) ** 2) / (scale * (area[:, None] + 2.220446049250313e-16)))
        return pa.array(near.sum(axis=1) / len(sigmas), mask=~known)

    return similarity(*a, *b, area)


def head_size(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """0.6 of the head box's diagonal."""
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * 0.6


def pckh_distance(ax: Column, ay: Column, bx: Column, by: Column, head: Column) -> Column:
    """Distance of two joints over the head size."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / head


def pckh_similarity(distance: Column, limit: float = 0.5001) -> Column:
    """1 at distance 0, falling to 0 at ``limit``."""
    return F.greatest(F.lit(0.0), 1 - distance / limit)


def is_valid(x: Column, y: Column) -> Column:
    return (x > 0) & (y > 0)


def n_valid(joints: Column) -> Column:
    return F.size(F.filter(joints, lambda j: is_valid(j["x"], j["y"])))
