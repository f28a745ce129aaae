"""Segmentation masks as run lengths: counts of zeros and ones in turn, beginning with zeros, down the columns of an image.

A mask is an ``array<int>`` of counts for an image of a known height. Overlaps, boxes and crops are taken from runs, never
from pixels; whole Arrow batches of masks are handled as flat arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def _flat(counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all counts; null masks and null counts have none."""
    sizes = np.diff(counts.offsets.to_numpy()) if len(counts) else np.empty(0, np.int64)
    sizes = np.where(counts.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    values = counts.flatten()
    return np.repeat(np.arange(len(counts)), sizes), values.fill_null(0).to_numpy().astype(np.int64)


def runs(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the runs of ones of all masks, and the number of pixels of each mask."""
    owner, value = _flat(counts)
    total = np.bincount(owner, value, len(counts)).astype(np.int64)
    before = np.cumsum(total) - total
    end = np.cumsum(value) - before[owner]
    first = np.searchsorted(owner, owner)
    ones = ((np.arange(len(owner)) - first) % 2 == 1) & (value > 0)
    return owner[ones], (end - value)[ones], end[ones], total


def counts_of(owner: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray) -> pa.Array:
    """Masks of sorted runs; runs that meet become one, and a mask without runs is one count of zeros."""
    meets = np.r_[False, (owner[1:] == owner[:-1]) & (start[1:] == end[:-1])] if len(owner) else np.empty(0, bool)
    head = np.flatnonzero(~meets)
    tail = np.r_[head[1:], len(owner)] - 1 if len(head) else head
    owner, start, end = owner[head], start[head], end[tail]
    same = np.r_[False, owner[1:] == owner[:-1]] if len(owner) else np.empty(0, bool)
    gap = start - np.where(same, np.r_[0, end[:-1]] if len(end) else end, 0)
    n = np.bincount(owner, minlength=len(total))
    last = np.zeros(len(total), np.int64)
    last[owner] = end  # sorted, so the last run of a mask stays
    rest = total - last
    sizes = 2 * n + (rest > 0)
    out = np.zeros(sizes.sum(), np.int32)
    at = (np.cumsum(sizes) - sizes)[owner] + 2 * (np.arange(len(owner)) - np.searchsorted(owner, owner))
    out[at], out[at + 1] = gap, end - start
    out[(np.cumsum(sizes) - 1)[rest > 0]] = rest[rest > 0]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(out))


def intersections(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Common ones of each pair of masks: a merge of sorted runs, for all pairs by one binary search."""
    ao, start, stop, total = runs(a)
    bo, low, high, other = runs(b)
    if not len(ao) or not len(bo):
        return np.zeros(len(a), np.int64)
    width = int(max(total.max(), other.max())) + 1
    ends, sums = bo * width + high, np.r_[0, np.cumsum(high - low)]

    def covered(x: np.ndarray) -> np.ndarray:
        """Ones of all of ``b`` before position x of the mask."""
        k = np.searchsorted(ends, ao * width + x, side="right")
        inside = np.minimum(k, len(bo) - 1)
        part = np.where((k < len(bo)) & (bo[inside] == ao), np.maximum(x - low[inside], 0), 0)
        return sums[k] + part

    return np.bincount(ao, covered(stop) - covered(start), len(a)).astype(np.int64)


def cropped(counts: pa.Array, height: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> pa.Array:
    """Masks of the windows [x1, x2) x [y1, y2) inside the images."""
    owner, start, end, _ = runs(counts)
    column, last = start // height[owner], (end - 1) // height[owner]
    n = last - column + 1
    piece = np.repeat(np.arange(len(owner)), n)
    own, x = owner[piece], column[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    top = np.maximum(np.where(x == column[piece], start[piece] % height[own], 0), y1[own]) - y1[own]
    bottom = np.minimum(np.where(x == last[piece], (end[piece] - 1) % height[own] + 1, height[own]), y2[own]) - y1[own]
    kept = (x >= x1[own]) & (x < x2[own]) & (top < bottom)
    tall = np.maximum(y2 - y1, 0)
    base = (x - x1[own]) * tall[own]
    return counts_of(own[kept], (base + top)[kept], (base + bottom)[kept], np.maximum(x2 - x1, 0) * tall)


def text_of(counts: pa.Array) -> pa.Array:
    """The compressed text form: counts from the fourth on less those two before, in groups of five bits from 48 on."""
    owner, value = _flat(counts)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    far = np.flatnonzero(place > 2)
    left = value.copy()
    left[far] -= value[far - 2]
    who, signs, open_ = [], [], np.arange(len(owner))
    step = 0
    while len(open_):
        bits = left[open_] & 31
        left[open_] >>= 5
        more = left[open_] != np.where(bits & 16, -1, 0)
        who.append(np.stack([open_, np.full(len(open_), step)]))
        signs.append((bits | np.where(more, 32, 0)) + 48)
        open_, step = open_[more], step + 1
    if not who:
        return pa.array([None if v is None else "" for v in counts.to_pylist()], pa.string())
    at, sign = np.concatenate(who, axis=1), np.concatenate(signs).astype(np.uint8)
    sign = sign[np.argsort(at[0], kind="stable")]  # steps are in their order already
    ends = np.cumsum(np.bincount(owner[at[0]], minlength=len(counts)))
    whole = pa.StringArray.from_buffers(len(counts), pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(sign))
    return pc.if_else(counts.is_valid(), whole, None) if counts.null_count else whole


def counts_from(text: pa.Array) -> pa.Array:
    """Counts from the compressed text form; null stays null, and signs after the last whole count are left out."""
    known = text.fill_null("")
    sizes = pc.binary_length(known).to_numpy().astype(np.int64)
    sign = np.frombuffer("".join(known.to_pylist()).encode(), np.uint8).astype(np.int64) - 48
    owner, starts = np.repeat(np.arange(len(text)), sizes), np.cumsum(sizes) - sizes
    ends = np.flatnonzero(sign & 32 == 0)
    whose = owner[ends]
    firsts = np.maximum(np.r_[0, ends[:-1] + 1], starts[whose]) if len(ends) else ends
    n = ends - firsts + 1
    heads = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(heads, n)
    value = np.add.reduceat((sign[np.repeat(firsts, n) + place] & 31) << (5 * place), heads) if len(ends) else np.empty(0, np.int64)
    value -= np.where(sign[ends] & 16, 1 << (5 * n), 0)
    counts = np.bincount(whose, minlength=len(text))
    nth = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
    for k in (1, 2):  # each count from the fourth on goes on from the one two before
        at = np.flatnonzero((nth >= k) & ((nth - k) % 2 == 0))
        if len(at):
            total, head = np.cumsum(value[at]), np.flatnonzero(nth[at] == k)
            before = (total - value[at])[head]
            value[at] = total - np.repeat(before, np.diff(np.r_[head, len(at)]))
    nulls = pa.array(~text.is_valid().to_numpy(zero_copy_only=False)) if text.null_count else None
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(value.astype(np.int32)), mask=nulls)


def boxes_of(counts: pa.Array, height: np.ndarray) -> pa.Array:
    """Smallest box ``x, y, w, h`` of the ones of each mask; null if there are none. A run over a column's end fills the height."""
    owner, start, end, _ = runs(counts)
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    tall = height[owner]
    first, last = start // tall, (end - 1) // tall
    out = {c: np.zeros(len(counts), np.int32) for c in ("x", "y", "w", "h")}
    none = np.ones(len(counts), bool)
    if len(head):
        some, tail = owner[head], np.r_[head[1:], len(owner)] - 1
        top = np.minimum.reduceat(np.where(first < last, 0, start % tall), head)
        bottom = np.maximum.reduceat(np.where(first < last, tall - 1, (end - 1) % tall), head)
        out["x"][some], out["w"][some] = first[head], last[tail] - first[head] + 1
        out["y"][some], out["h"][some] = top, bottom - top + 1
        none[some] = False
    return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], list(out), mask=pa.array(none))


@F.arrow_udf(LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(intersections(a, b))


@F.arrow_udf(ArrayType(IntegerType()))
def _crop(counts: pa.Array, height: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
    return cropped(counts, *(v.fill_null(0).to_numpy().astype(np.int64) for v in (height, x1, y1, x2, y2)))


@F.arrow_udf(StringType())
def _text(counts: pa.Array) -> pa.Array:
    return text_of(counts)


@F.arrow_udf(ArrayType(IntegerType()))
def _counts(text: pa.Array) -> pa.Array:
    return counts_from(text)


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in ("x", "y", "w", "h")]))
def _box(counts: pa.Array, height: pa.Array) -> pa.Array:
    return boxes_of(counts, height.fill_null(0).to_numpy().astype(np.int64))


def rle_area(counts: Column) -> Column:
    """Ones of a mask."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def rle_common(a: Column, b: Column) -> Column:
    """Ones that two masks of one image have in common."""
    return _common(a, b)


def rle_iou(a: Column, b: Column) -> Column:
    """Intersection over union; null if both masks are empty."""
    common = rle_common(a, b)
    return F.try_divide(common, rle_area(a) + rle_area(b) - common)


def rle_ioa(a: Column, b: Column) -> Column:
    """Intersection over the first mask's area, as for ignored crowds; null if it is empty."""
    return F.try_divide(rle_common(a, b), rle_area(a))


def rle_crop(counts: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The mask of the window [x1, x2) x [y1, y2), which lies inside the image."""
    return _crop(counts, height, x1, y1, x2, y2)


def rle_text(counts: Column) -> Column:
    return _text(counts)


def rle_counts(text: Column) -> Column:
    return _counts(text)


def rle_of_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Counts of a box of whole pixels, cut to the image."""
    x1, y1 = F.least(F.greatest(x, F.lit(0)), width), F.least(F.greatest(y, F.lit(0)), height)
    nx = F.greatest(F.least(x + w, width) - x1, F.lit(0))
    ny = F.greatest(F.least(y + h, height) - y1, F.lit(0))
    head = F.array(x1 * height + y1)
    columns = F.flatten(F.array_repeat(F.array(ny, height - ny), (nx - 1).cast("int")))
    rest = width * height - (x1 * height + y1) - ((nx - 1) * height + ny)
    whole = F.array(x1 * height, nx * height, (width - x1 - nx) * height)
    each = F.concat(head, columns, F.array(ny), F.array(rest))
    counts = F.when((nx <= 0) | (ny <= 0), F.array(width * height)).when(ny == height, whole).otherwise(each)
    return F.when(F.size(counts) % 2 == 1, F.when(F.element_at(counts, -1) > 0, counts).otherwise(F.slice(counts, F.lit(1), F.greatest(F.size(counts) - 1, F.lit(1))))).otherwise(counts).cast("array<int>")


def rle_box(counts: Column, height: Column) -> Column:
    """Smallest box ``x, y, w, h`` of the ones, from the runs; null if there are none. A run over a column's end fills the height."""
    return _box(counts, height)
