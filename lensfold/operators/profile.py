"""Dataset profiles: splits, identities, cameras, pixel moments and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_stats(images: DataFrame) -> DataFrame:
    """Per ``split`` and as ``total``: images, identities, cameras, sizes of ``images(split, pid, cam, width, height)``.

    Names that could not be read have a null pid or cam and count as images only.
    """
    name = F.when(F.grouping("split") == 1, F.lit("total")).otherwise(F.col("split"))
    size = [f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))]
    average = [F.floor(F.sum(c) / F.count(c)).cast("long").alias(f"avg_{c}") for c in ("width", "height")]
    out = images.rollup("split").agg(name.alias("name"), F.count("*").alias("num_images"), F.count_distinct("pid").alias("num_ids"), F.count_distinct("cam").alias("num_cameras"), *size, *average)
    return out.drop("split").withColumnRenamed("name", "split")


def sampled_dimensions(images: DataFrame, n: int = 1000) -> DataFrame:
    """Floored mean size of the first ``n`` images by name."""
    first = images.orderBy("name").limit(n)
    return first.agg(*[F.floor(F.sum(c) / F.count(c)).cast("long").alias(f"avg_{c}") for c in ("width", "height")], F.count("*").alias("sampled"))


def distribution(images: DataFrame, column: str) -> DataFrame:
    """Images per value of ``column``; unread names are left out."""
    return images.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def pixel_moments(values: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, from sums and sums of squares in one pass."""
    aggregates = []
    for c in columns:
        mean, square = F.sum(c) / F.count(c), F.sum(F.col(c) * F.col(c)) / F.count(c)
        aggregates += [mean.alias(f"{c}_mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"{c}_std")]
    return values.agg(*aggregates)


def id_distribution(images: DataFrame) -> DataFrame:
    """One row on images per identity: mean, median, extremes, deviation, and identities with < 5, 5 to 19 and >= 20 images."""
    per = distribution(images, "pid")
    buckets = {"few": F.col("n") < 5, "some": (F.col("n") >= 5) & (F.col("n") < 20), "many": F.col("n") >= 20}
    return per.agg(
        F.count("*").alias("ids"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("min"), F.max("n").alias("max"), F.stddev_pop("n").alias("std"),
        *[F.count_if(c).alias(k) for k, c in buckets.items()], *[(F.count_if(c) * 100 / F.count("*")).alias(f"{k}_percent") for k, c in buckets.items()],
    )


def id_histogram(images: DataFrame, bins: int = 50) -> DataFrame:
    """Identities per bin of equal width over the images that they have."""
    per = distribution(images, "pid")
    ends = per.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("n") - F.col("lo")) / width), F.lit(bins - 1)))
    return per.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("ids"))  # one row


def cross_camera(images: DataFrame) -> DataFrame:
    """One row: identities, those seen by more than one camera, and cameras per such identity."""
    per = images.filter("pid is not null").groupBy("pid").agg(F.count_distinct("cam").alias("cams"))
    return per.agg(F.count("*").alias("ids"), F.count_if(F.col("cams") > 1).alias("cross_ids"), F.avg(F.when(F.col("cams") > 1, F.col("cams"))).alias("avg_cams"))


def ids_per_camera(images: DataFrame) -> DataFrame:
    return images.filter("pid is not null and cam is not null").groupBy("cam").agg(F.count_distinct("pid").alias("ids"))


def split_overlap(images: DataFrame, a: str, b: str) -> DataFrame:
    """One row: identities in both splits, in ``a`` only, and whether those of ``a`` are all in ``b``."""
    ids = images.filter("pid is not null").groupBy("pid").agg(F.bool_or(F.col("split") == a).alias("in_a"), F.bool_or(F.col("split") == b).alias("in_b"))
    only = F.count_if(F.col("in_a") & ~F.col("in_b"))
    return ids.agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("common"), only.alias("only_a"), (only == 0).alias("is_subset"))


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pid").intersect(b.select("pid"))


def missing_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pid").exceptAll(b.select("pid")).distinct()


def repeated_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def frame_mismatch(gt: DataFrame, tr: DataFrame) -> DataFrame:
    """Sequences whose number of frames differs between the sides."""
    a, b = (x.groupBy("seq").agg(F.count_distinct("frame_id").alias(n)) for x, n in ((gt, "gt_frames"), (tr, "tr_frames")))
    return a.join(b, "seq", "full_outer").fillna(0).filter("gt_frames <> tr_frames")


def unknown_values(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are not among the allowed ones: frames beyond a sequence, classes that do not exist."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti")


def labelled_only(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of frames that are labelled."""
    return rows.join(labelled.select("seq", "frame_id").distinct(), ["seq", "frame_id"], "left_semi")


def remap(rows: DataFrame, column: str, names: dict[int, int]) -> DataFrame:
    """``column`` with each value replaced by its entry in ``names`` (a literal map), null without one."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return rows.withColumn(column, F.try_element_at(F.create_map(*pairs), F.col(column)))


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least ``order`` of each key."""
    own = F.struct(order, *[c for c in rows.columns if c != order])
    return rows.groupBy(*keys).agg(F.min(own).alias("row")).select("row.*").select(*rows.columns)


def reduced(rows: DataFrame, keys: list[str], values: list[str], mean: bool = False) -> DataFrame:
    """Sums, or means, of values reported by several workers."""
    fn: callable = F.avg if mean else F.sum
    return rows.groupBy(*keys).agg(*[fn(v).alias(v) for v in values])


def with_ids(names: DataFrame, ids: tuple[Column, Column]) -> DataFrame:
    return names.withColumn("pid", ids[0]).withColumn("cam", ids[1])
