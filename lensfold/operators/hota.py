"""The HOTA family: detection, association and localisation accuracy at 19 similarity thresholds.

``pairs(seq, t, gt_id, tr_id, sim)`` are the positive similarities of a frame (absent: 0), ``gt(seq, t, id)`` and ``tr(seq, t, id)`` the
detections. A frame's matching needs only the sequence's counts, so frames are solved independently of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lensfold.operators.assignment import best_edges, places_in_groups
from lensfold.operators.boxes import normalised_similarity
from lensfold.operators.groups import Group, dealt, fold_batches, group_starts, settled

#: Thresholds .05 to .95.
ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 20))
EPS = 2.220446049250313e-16
TINY = 1e-10
COUNTS = ("hota_tp", "hota_fn", "hota_fp")
MEANS = ("loca", "assa", "assre", "asspr", "fraga")


def id_frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "id").agg(F.count("*").alias("n"))


def alignment(pairs: DataFrame, gt: DataFrame, tr: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, gt_id, tr_id, align``: how well two identities go together over all frames, before any matching."""
    shared = normalised_similarity(pairs, [*keys, "t"], "gt_id", "tr_id", "sim").groupBy(*keys, "gt_id", "tr_id").agg(F.sum("align").alias("potential"))
    g, t = id_frames(gt, keys).withColumnRenamed("id", "gt_id").withColumnRenamed("n", "gc"), id_frames(tr, keys).withColumnRenamed("id", "tr_id").withColumnRenamed("n", "tc")
    both = shared.join(g, [*keys, "gt_id"]).join(t, [*keys, "tr_id"])
    return both.select(*keys, "gt_id", "tr_id", (F.col("potential") / (F.col("gc") + F.col("tc") - F.col("potential"))).alias("align"))


def matches(pairs: DataFrame, gt: DataFrame, tr: DataFrame, keys: list[str], aligned: bool = True) -> DataFrame:
    """``keys, t, gt_id, tr_id, sim`` of the matching of each frame that has the greatest total score; one for all thresholds.

    A pair's score is its alignment times its similarity, or, if not ``aligned``, its similarity; absent pairs score 0.
    """
    if aligned:
        scored = pairs.join(alignment(pairs, gt, tr, keys), [*keys, "gt_id", "tr_id"]).withColumn("score", F.col("align") * F.col("sim"))
    else:
        scored = pairs.withColumn("score", F.col("sim"))
    scored = scored.select(*keys, "t", "gt_id", "tr_id", "sim", "score")
    kept = scored.drop("score").schema
    names = kept.names

    def solve(g: Group, starts: np.ndarray) -> Group | None:
        own = best_edges(starts, g["gt_id"], g["tr_id"], g["score"])
        return {n: g[n][own] for n in names} if len(own) else None

    return fold_batches(scored, [*keys, "t"], solve, kept)


def matches_per_alpha(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Matchings made anew for each threshold: most pairs that reach it first, then most similarity; absent pairs score 0.

    Adds ``at``, with bit k set where the pair is matched at the k-th of ``ALPHAS``; a pair is one row for all of them.
    """
    near = pairs.select(*keys, "t", "gt_id", "tr_id", "sim")

    def solve(g: Group, starts: np.ndarray) -> Group | None:
        sizes = np.diff(np.append(starts, len(g["sim"])))
        group = np.repeat(np.arange(len(starts)), sizes)
        compete = np.logical_or(*(places_in_groups(starts, group, g[c])[1] < sizes for c in ("gt_id", "tr_id")))
        own = np.flatnonzero(compete[group])  # elsewhere each pair is matched wherever it reaches the threshold
        chosen, at = np.ones(len(group), bool), np.zeros(len(group), np.int64)
        before = None
        for k, alpha in enumerate(ALPHAS):
            over = g["sim"] >= alpha - EPS
            if len(own):
                new = np.zeros(len(starts), bool)
                new[group[own if before is None else own[over[own] != before[own]]]] = True
                again, before = own[new[group[own]]], over
                if len(again):
                    first = np.flatnonzero(np.append(True, group[again][1:] != group[again][:-1]))
                    chosen[again] = False
                    chosen[again[best_edges(first, g["gt_id"][again], g["tr_id"][again], np.where(over, 1000.0, 0.0)[again] + g["sim"][again])]] = True
            at |= (chosen & over).astype(np.int64) << k
        used = np.flatnonzero(at)
        return {n: v[used] for n, v in g.items()} | {"at": at[used]} if len(used) else None

    return fold_batches(near, [*keys, "t"], solve, near.withColumn("at", F.lit(0).cast("long")).schema)


class Runs:
    """Counts of matches, which come in the order of group and time through batches; a run is what an object keeps of one hypothesis.

    Only the run that each threshold has open is held. A run of n matches that goes on with m more adds m * m + 2 * n * m to
    the squares, so nothing has to wait for its end.
    """

    def __init__(self) -> None:
        self.group: tuple | None = None
        self.open: list[tuple | None] = [None] * len(ALPHAS)

    def add(self, group: list[tuple], of: np.ndarray, tr_id: np.ndarray, sim: np.ndarray, at: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """``group, tr, alpha, m, squares, sim`` of a batch: places in the names ``group`` and in ``tr_id``, whose rows are ``of`` them."""
        if group[0] != self.group:
            self.open = [None] * len(ALPHAS)
        ids, tr = np.unique(tr_id, return_inverse=True)
        codes, first, code = np.unique(of * len(ids) + tr, return_index=True, return_inverse=True)
        out = []
        for k, alpha in enumerate(ALPHAS):
            own = np.flatnonzero(sim >= alpha - EPS if at is None else at >> k & 1)
            if not len(own):
                self.open[k] = self.open[k] if len(group) == 1 else None
                continue
            c = code[own]
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))  # codes tell groups and hypotheses apart
            n = np.diff(np.append(starts, len(c)))
            squares = (n * n).astype(np.float64)
            length = int(n[-1])
            if self.open[k] is not None and of[own[0]] == 0 and self.open[k][0] == tr_id[own[0]]:
                squares[0] += 2.0 * self.open[k][1] * n[0]
                length += self.open[k][1] if len(n) == 1 else 0
            self.open[k] = (tr_id[own[-1]], length) if of[own[-1]] == len(group) - 1 else None
            m = np.bincount(c, minlength=len(codes))
            used = np.flatnonzero(m)
            sums = np.bincount(c[starts], squares, len(codes)), np.bincount(c, sim[own], len(codes))
            out.append((of[first[used]], first[used], np.full(len(used), alpha), m[used], *(x[used] for x in sums)))
        self.group = group[-1]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else ()


def run_sums(matched: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, alpha, gt_id, tr_id, m, squares, sim``: matches, the sum of squared lengths of their runs and of similarities.

    ``matched`` has a row a match for all thresholds that its similarity reaches, or for those in ``at``. Rows may be partial sums.
    """
    own = [*keys, "gt_id"]
    rows = matched.select(*own, "t", "tr_id", "sim", *(["at"] if "at" in matched.columns else []))
    names = rows.columns
    kinds = [*(rows.schema[c] for c in (*own, "tr_id")), StructField("alpha", DoubleType()), StructField("m", LongType()), StructField("squares", DoubleType()), StructField("sim", DoubleType())]
    kind = StructType(kinds)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            if not batch.num_rows:
                continue
            g = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            starts = group_starts(g, own)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            found = runs.add(list(zip(*(g[c][starts].tolist() for c in own), strict=True)), of, g["tr_id"], g["sim"], g.get("at"))
            if found:
                group, tr, *sums = found
                columns = [*(g[c][starts][group] for c in own), g["tr_id"][tr], *sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt(rows, own, ("t",)).mapInArrow(run, kind)


def _sizes(gt: DataFrame, tr: DataFrame, keys: list[str]) -> DataFrame:
    g = gt.groupBy(*keys).agg(F.count("*").alias("gt_dets"))
    t = tr.groupBy(*keys).agg(F.count("*").alias("tr_dets"))
    sides = g.join(t, keys, "full_outer").fillna(0, ["gt_dets", "tr_dets"])
    return sides.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))


def fields(matched: DataFrame, gt: DataFrame, tr: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` and ``alpha``: counts, localisation and association sums, from matches as for :func:`run_sums`.

    One side empty: its counts stand, the others are 0 and the localisation is 1.
    """
    own = [*keys, "alpha"]
    pairs = run_sums(matched, keys).groupBy(*own, "gt_id", "tr_id").agg(*[F.sum(c).alias(c) for c in ("m", "squares", "sim")])
    g, t = id_frames(gt, keys).withColumnRenamed("id", "gt_id").withColumnRenamed("n", "gc"), id_frames(tr, keys).withColumnRenamed("id", "tr_id").withColumnRenamed("n", "tc")
    pairs = pairs.join(g, [*keys, "gt_id"]).join(t, [*keys, "tr_id"])
    either = F.col("gc") + F.col("tc") - F.col("m")
    sums = pairs.groupBy(*own).agg(F.sum("m").alias("hota_tp"), F.sum("sim").alias("sim"), F.sum(F.col("m") * F.col("m") / either).alias("ass"), F.sum(F.col("m") * F.col("m") / F.col("gc")).alias("re"), F.sum(F.col("m") * F.col("m") / F.col("tc")).alias("pr"), F.sum(F.col("squares") / either).alias("frag"))
    rows = _sizes(gt, tr, keys).join(sums, own, "left").fillna(0, ["hota_tp", "sim", "ass", "re", "pr", "frag"])
    tp = F.greatest(F.col("hota_tp"), F.lit(1))
    one_side = (F.col("gt_dets") == 0) | (F.col("tr_dets") == 0)
    loca = F.when(one_side, F.lit(1.0)).otherwise(F.greatest(F.col("sim"), F.lit(TINY)) / F.greatest(F.col("hota_tp").cast("double"), F.lit(TINY)))
    return rows.select(*own, F.col("hota_tp").cast("long").alias("hota_tp"), (F.col("gt_dets") - F.col("hota_tp")).cast("long").alias("hota_fn"), (F.col("tr_dets") - F.col("hota_tp")).cast("long").alias("hota_fp"), loca.alias("loca"), (F.col("ass") / tp).alias("assa"), (F.col("re") / tp).alias("assre"), (F.col("pr") / tp).alias("asspr"), (F.col("frag") / tp).alias("fraga"))


def final_fields(rows: DataFrame) -> DataFrame:
    """Add detection recall, precision and accuracy, and the combined scores."""
    tp, fn, fp = (F.col(c) for c in COUNTS)
    one = F.lit(1)
    rows = rows.withColumn("detre", tp / F.greatest(one, tp + fn)).withColumn("detpr", tp / F.greatest(one, tp + fp)).withColumn("deta", tp / F.greatest(one, tp + fn + fp))
    return rows.withColumn("hota", F.sqrt(F.col("deta") * F.col("assa"))).withColumn("rhota", F.sqrt(F.col("detre") * F.col("assa"))).withColumn("fa_hota", F.sqrt(F.col("deta") * F.sqrt(F.col("assa") * F.col("fraga")))).withColumn("fa_rhota", F.sqrt(F.col("detre") * F.sqrt(F.col("assa") * F.col("fraga"))))


def combine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences together, per ``keys`` and ``alpha``: counts add, the others are averages by true positives."""
    weight = F.col("hota_tp")
    sums = rows.groupBy(*keys, "alpha").agg(*[F.sum(c).alias(c) for c in COUNTS], *[(F.sum(F.col(c) * weight) / F.greatest(F.lit(1), F.sum(weight))).alias(c) for c in MEANS])
    return final_fields(sums)


def class_averaged(rows: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """Mean over classes per ``alpha`` of ``rows(class, alpha, ..)``; classes without detections are left out."""
    used = rows.filter(F.col("hota_tp") + F.col("hota_fn") + F.col("hota_fp") > 0) if ignore_empty else rows
    return used.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.avg(c).alias(c) for c in (*MEANS, "detre", "detpr", "deta", "hota", "rhota", "fa_hota", "fa_rhota")])


def detection_averaged(rows: DataFrame) -> DataFrame:
    """All classes as one, per ``alpha``."""
    return combine(rows, [])


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means over the thresholds, and the values at the first one as ``.._0``."""
    means = ("hota", "deta", "assa", "detre", "detpr", "assre", "asspr", "loca", "rhota", "fraga", "fa_hota", "fa_rhota")
    first = [F.max(F.when(F.col("alpha") == ALPHAS[0], F.col(c))).alias(f"{c}_0") for c in ("hota", "loca")]
    at_first = dict(zip(("hota_0", "loca_0"), first, strict=True))
    return rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], *at_first.values()).withColumn("hotaloca_0", F.col("hota_0") * F.col("loca_0"))


def evaluate(pairs: DataFrame, gt: DataFrame, tr: DataFrame, keys: list[str] | None = None, matching: str = "aligned") -> DataFrame:
    """HOTA per ``keys`` (``seq``; with ``joint``, per joint) and ``alpha``.

    ``matching`` decides what a frame's matching maximises: ``aligned`` similarity, ``similarity`` alone (per joint), or
    ``per_alpha`` true positives and then similarity, anew for each threshold (identities over a whole dataset).
    """
    keys = keys or ["seq"]
    if matching not in ("aligned", "similarity", "per_alpha"):
        raise ValueError(f"unknown matching {matching}")
    found = matches_per_alpha(pairs, keys) if matching == "per_alpha" else matches(pairs, gt, tr, keys, matching == "aligned")
    return final_fields(fields(found, gt, tr, keys))


def counts(gt: DataFrame, tr: DataFrame, frames: DataFrame) -> DataFrame:
    """Per sequence of ``frames(seq, t)``: detections and identities of both sides, and frames."""
    g = gt.groupBy("seq").agg(F.count("*").alias("gt_dets"), F.count_distinct("id").alias("gt_ids"))
    t = tr.groupBy("seq").agg(F.count("*").alias("dets"), F.count_distinct("id").alias("ids"))
    f = frames.groupBy("seq").agg(F.count_distinct("t").alias("frames"))
    return f.join(g, "seq", "left").join(t, "seq", "left").fillna(0)


def global_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dense_id``: numbers from 0 for all identities of all sequences, without sorting the rows in one place.

    Distinct identities are dealt out by ranges; a number is its place in its range plus the sizes of those before.
    """
    ids = settled(rows.select(*keys).distinct().repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sizes = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return ids.withColumn("place", place).join(before, "part").select(*keys, (F.col("place") + F.col("before")).alias("dense_id"))


def dense_ids(column: str = "id", within: str = "seq") -> Column:
    """Numbers from 0 for the identities of each sequence."""
    return F.dense_rank().over(Window.partitionBy(within).orderBy(column)) - 1
