"""Box, point and pose geometry as Column expressions. Layouts are named in the arguments: ``xywh`` is top-left and size, ``xyxy`` two corners, ``cxcywh`` centre and size."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x", "y", "w", "h")) -> Box:
    """Four columns named ``prefix`` + name."""
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def xywh_to_xyxy(b: Box) -> Box:
    return b[0], b[1], b[0] + b[2], b[1] + b[3]


def xyxy_to_xywh(b: Box) -> Box:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def cxcywh_to_xyxy(b: Box) -> Box:
    return b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2


def xyxy_to_cxcywh(b: Box) -> Box:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def area(b: Box) -> Column:
    """Area of an xyxy box; 0 if a side is negative."""
    zero = F.lit(0.0)
    return F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    """Common area of two xyxy boxes."""
    zero = F.lit(0.0)
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(zero, w) * F.greatest(zero, h)


def union_area(a: Box, b: Box) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Intersection over union of xyxy boxes; 0 where the union is not larger than ``eps``."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > eps, inter / union).otherwise(F.lit(0.0))


def ioa(a: Box, b: Box, eps: float = 0.0) -> Column:
    """Share of the first xyxy box that the second covers; 0 for a box without area."""
    own = area(a)
    return F.when(own > eps, intersection(a, b) / own).otherwise(F.lit(0.0))


def giou(a: Box, b: Box) -> Column:
    """Generalised IoU: IoU less the share of the common hull that neither box covers."""
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    union = union_area(a, b)
    return F.when((union > 0) & (hull > 0), intersection(a, b) / union - (hull - union) / hull)


def clip(b: Box, width: Column, height: Column) -> Box:
    """An xyxy box cut to the image."""
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(b[0], width)), F.greatest(zero, F.least(b[1], height)), F.greatest(zero, F.least(b[2], width)), F.greatest(zero, F.least(b[3], height))


def letterbox(src_w: Column, src_h: Column, dst_w: float, dst_h: float) -> tuple[Column, Column, Column]:
    """Scale ratio and left and top padding that fit an image into another size."""
    ratio = F.least(dst_w / src_w, dst_h / src_h)
    return ratio, (dst_w - src_w * ratio) / 2, (dst_h - src_h * ratio) / 2


def unletterbox(b: Box, src_w: Column, src_h: Column, dst_w: float, dst_h: float) -> Box:
    """An xyxy box of the letterboxed image in the source image's pixels, clamped to it."""
    ratio, left, top = letterbox(src_w, src_h, dst_w, dst_h)
    return clip(((b[0] - left) / ratio, (b[1] - top) / ratio, (b[2] - left) / ratio, (b[3] - top) / ratio), src_w, src_h)


def revert(b: Box, eval_w: float, eval_h: float, pad_left: float, pad_top: float, orig_w: Column, orig_h: Column, input_w: float, input_h: float) -> Box:
    """A normalised xyxy box back in original pixels: to evaluation size, less the padding, times original over input size."""
    sx, sy = orig_w / input_w, orig_h / input_h
    return (b[0] * eval_w - pad_left) * sx, (b[1] * eval_h - pad_top) * sy, (b[2] * eval_w - pad_left) * sx, (b[3] * eval_h - pad_top) * sy


def crop(b: Box, left: float, top: float, width: float, height: float) -> Box:
    """An xyxy box in the frame of a crop, clamped to it."""
    return clip((b[0] - left, b[1] - top, b[2] - left, b[3] - top), F.lit(float(width)), F.lit(float(height)))


def hflip(b: Box, width: Column) -> Box:
    return width - b[2], b[1], width - b[0], b[3]


def resize(b: Box, ratio_w: Column, ratio_h: Column) -> Box:
    return b[0] * ratio_w, b[1] * ratio_h, b[2] * ratio_w, b[3] * ratio_h


def point_in_box(x: Column, y: Column, b: Box) -> Column:
    return (x > b[0]) & (x < b[2]) & (y > b[1]) & (y < b[3])


def side_distances(x: Column, y: Column, b: Box) -> tuple[Column, Column, Column, Column]:
    """Distances of a point to the left, top, right and bottom side of an xyxy box; all positive inside."""
    return x - b[0], y - b[1], b[2] - x, b[3] - y


def point_in_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point is inside a closed polygon given as two arrays, by counting the edges right of it."""
    n = F.size(xs)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(xs[i].alias("x1"), ys[i].alias("y1"), xs[F.pmod(i + 1, n)].alias("x2"), ys[F.pmod(i + 1, n)].alias("y2")))
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"])
    return (n > 2) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: xs[i] * ys[F.pmod(i + 1, n)] - xs[F.pmod(i + 1, n)] * ys[i])
    return F.when(n > 2, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(F.lit(0.0))


def box_polygon_area(b: Box, xs: Column, ys: Column) -> Column:
    """Common area of an xyxy box and a simple polygon given as two arrays of corners.

    Each edge adds the area between it and the box's lower side over the part of its range inside the box, with heights
    clamped to the box; edges that run back take it off again. The mean of a clamped height over an edge comes from the
    antiderivative of clamping, so a polygon is one fold over its edges.
    """
    n, (left, low, right, high) = F.size(xs), b
    inside = lambda v: F.least(F.greatest(v, left), right)
    clamp = lambda y: F.least(F.greatest(y, low), high)
    total = lambda y: F.when(y < low, low * y).when(y > high, high * y - high * high / 2 + low * low / 2).otherwise(y * y / 2 + low * low / 2)

    def edge(i: Column) -> Column:
        x1, y1, x2, y2 = xs[i], ys[i], xs[F.pmod(i + 1, n)], ys[F.pmod(i + 1, n)]
        u, v = inside(x1), inside(x2)
        slope = (y2 - y1) / F.when(x2 == x1, F.lit(1.0)).otherwise(x2 - x1)
        at = lambda x: y1 + slope * (x - x1)
        flat = F.abs(at(v) - at(u)) < 1e-9
        mean = F.when(flat, clamp((at(u) + at(v)) / 2)).otherwise((total(at(v)) - total(at(u))) / F.when(flat, F.lit(1.0)).otherwise(at(v) - at(u)))
        return F.when(u == v, F.lit(0.0)).otherwise((v - u) * (mean - low))

    edges = F.transform(F.sequence(F.lit(0), n - 1), edge)
    return F.when(n > 2, F.abs(F.aggregate(edges, F.lit(0.0), lambda a, x: a + x))).otherwise(F.lit(0.0))


def split_ring(ring: np.ndarray, digits: int = 9) -> list[np.ndarray]:
    """The simple rings into which a ring falls at the points where it crosses or touches itself; corners are rows.

    Every edge is cut where another one meets it; whenever the walk comes back to a point it has been at, what lies between is
    a ring of its own. Rings without area are left out.
    """
    path: list[tuple[float, float]] = []
    for k, (p, q) in enumerate(zip(ring, np.roll(ring, -1, axis=0), strict=True)):
        shares = [0.0]
        for j, (a, b) in enumerate(zip(ring, np.roll(ring, -1, axis=0), strict=True)):
            d, e = q - p, b - a
            cross = d[0] * e[1] - d[1] * e[0]
            if j != k and abs(cross) > 1e-12:
                t, u = ((a - p)[0] * e[1] - (a - p)[1] * e[0]) / cross, ((a - p)[0] * d[1] - (a - p)[1] * d[0]) / cross
                if -1e-12 <= u <= 1 + 1e-12 and 1e-12 < t < 1 - 1e-12:
                    shares.append(t)
        path += [tuple(np.round(p + (q - p) * t, digits) + 0.0) for t in sorted(shares)]
    walk: list[tuple[float, float]] = []
    rings = []
    for point in path:
        if point in walk:
            at = walk.index(point)
            rings.append(walk[at:])
            walk = walk[:at]
        walk.append(point)
    return [np.array(r) for r in [*rings, walk] if ring_area(np.array(r).reshape(-1, 2)) > 0]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2) if len(ring) > 2 else 0.0


_RINGS = ArrayType(StructType([StructField("xs", ArrayType(DoubleType())), StructField("ys", ArrayType(DoubleType()))]))


@F.arrow_udf(_RINGS)
def _simple_rings(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """A batch's equal polygons are split once."""
    (x, own), (y, other) = ((v.offsets.to_pylist(), v.values.to_numpy(zero_copy_only=False)) for v in (xs, ys))
    known = pc.and_(xs.is_valid(), ys.is_valid()).to_pylist()
    places: dict[tuple[bytes, bytes] | None, int] = {}
    rings: list[list[dict]] = []
    of = []
    for k, both in enumerate(known):
        px, py = own[x[k] : x[k + 1]], other[y[k] : y[k + 1]]
        key = (px.tobytes(), py.tobytes()) if both else None
        if key not in places:
            places[key] = len(rings)
            parts = split_ring(np.column_stack((px.astype(float), py.astype(float)))) if both else []
            rings.append([{"xs": r[:, 0].tolist(), "ys": r[:, 1].tolist()} for r in parts])
        of.append(places[key])
    return pa.array(rings, to_arrow_type(_RINGS)).take(pa.array(of, pa.int64()))


def simple_rings(xs: Column, ys: Column) -> Column:
    """``array<struct<xs,ys>>``: the simple parts of a polygon that may cross itself; nothing for null."""
    return _simple_rings(xs, ys)


def box_from_pose(joints: Column, margin: float, width: Column, height: Column) -> Box:
    """xyxy box around the joints ``array<struct<x,y,score>>`` with positive coordinates, widened and clamped to the image."""
    seen = F.filter(joints, lambda j: (j["x"] > 0) & (j["y"] > 0))
    xs, ys = F.transform(seen, lambda j: j["x"]), F.transform(seen, lambda j: j["y"])
    return clip((F.array_min(xs) - margin, F.array_min(ys) - margin, F.array_max(xs) + margin, F.array_max(ys) + margin), width, height)


def affine_apply(x: Column, y: Column, m: tuple[Column | float, ...]) -> tuple[Column, Column]:
    """A point under the 2 x 3 matrix (a, b, c, d, e, f)."""
    return x * m[0] + y * m[1] + m[2], x * m[3] + y * m[4] + m[5]


def affine_inverse(m: tuple[Column, ...]) -> tuple[Column, ...]:
    det = m[0] * m[4] - m[1] * m[3]
    a, b, d, e = m[4] / det, -m[1] / det, -m[3] / det, m[0] / det
    return a, b, -(a * m[2] + b * m[5]), d, e, -(d * m[2] + e * m[5])


def affine_from_box(cx: Column, cy: Column, scale: Column, out_w: float, out_h: float) -> tuple[Column, ...]:
    """Matrix that maps a square of side ``scale`` round a centre to an output image."""
    k = F.lit(float(out_w)) / scale
    zero = F.lit(0.0)
    return k, zero, out_w / 2 - k * cx, zero, k, out_h / 2 - k * cy


def containment_score(joints: Column, b: Box, least: float = 0.0) -> Column:
    """Share of the joints' confidence that lies inside an xyxy box, over joints with more than ``least``."""
    used = F.filter(joints, lambda j: j["score"] > least)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, j: s + j["score"])
    inside = F.filter(used, lambda j: (j["x"] >= b[0]) & (j["x"] <= b[2]) & (j["y"] >= b[1]) & (j["y"] <= b[3]))
    return F.try_divide(total(inside), total(used))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Corner coordinates (xs, ys) of a box turned by ``angle`` radians."""
    c, s = F.cos(angle), F.sin(angle)
    corners = [(sx * w / 2, sy * h / 2) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return F.array(*[cx + u * c - v * s for u, v in corners]), F.array(*[cy + u * s + v * c for u, v in corners])


def mask_box(rows: Column) -> Column:
    """Smallest box (x1, y1, x2, y2) of the ones in a mask given as an array of rows of 0 and 1; null if it has none."""
    ys = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.array_contains(rows[i], 1))
    first = F.transform(rows, lambda r: F.when(F.array_contains(r, 1), F.array_position(r, 1) - 1))
    last = F.transform(rows, lambda r: F.when(F.array_contains(r, 1), F.size(r) - F.array_position(F.reverse(r), 1)))
    return F.when(F.size(ys) > 0, F.struct(F.array_min(first).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(last).alias("x2"), F.array_max(ys).alias("y2")))


def mask_iou(a: Column, b: Column) -> Column:
    """IoU of two masks given as flat arrays of 0 and 1 of equal length."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    common = total(F.zip_with(a, b, lambda x, y: x * y))
    return F.try_divide(common, total(a) + total(b) - common)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
