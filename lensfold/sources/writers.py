"""Sinks for results. Each returns the DataFrame that is written, so it can be looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.operators.groups import settled


def mot_rows(boxes: DataFrame) -> DataFrame:
    """Rows of the MOT result text for ``boxes(frame, track_id, x1, y1, x2, y2)``: one-based, with trailing -1 fields."""
    return boxes.select((F.col("frame") + 1).alias("frame"), F.col("track_id").alias("id"), (F.col("x1") + 1).alias("x"), (F.col("y1") + 1).alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), *[F.lit(-1).alias(n) for n in ("conf", "a", "b", "c")])


def write_mot(boxes: DataFrame, path: str) -> None:
    mot_rows(boxes).write.mode("overwrite").csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def coco_documents(boxes: DataFrame) -> DataFrame:
    """``json``: per image an object with its annotations, numbered from 1 over all, of ``boxes(image_id, category_id, x1, y1, x2, y2)``.

    Numbers follow image and place: each image's boxes are numbered, and the sizes of the images before are added.
    """
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("category_id", "x1", "y1", "x2", "y2"))
    sizes = settled(boxes.groupBy("image_id").agg(F.count("*").alias("n")).repartitionByRange("image_id").withColumn("part", F.spark_partition_id()))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m"))
    before = parts.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(before, "part").select("image_id", (F.col("base") + F.col("inside")).alias("start"))
    rows = boxes.withColumn("place", place).join(starts, "image_id").withColumn("id", F.col("start") + F.col("place"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    annotation = F.struct("id", "image_id", "category_id", F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"))
    return rows.groupBy("image_id").agg(F.to_json(F.struct(F.col("image_id"), F.array_sort(F.collect_list(annotation)).alias("annotations"))).alias("json"))


def categories(rows: DataFrame) -> DataFrame:
    return rows.select("category_id").distinct().orderBy("category_id")


def exported_detections(rows: DataFrame, least: float) -> DataFrame:
    """``image_id, bbox, score`` per image with a detection over the threshold; corners become sizes, negative corners 0."""
    b = rows.filter(F.col("score") >= least).withColumn("x1", F.greatest("x1", F.lit(0.0))).withColumn("y1", F.greatest("y1", F.lit(0.0)))
    return b.select("image_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), "score")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def summary_text(summary: DataFrame) -> DataFrame:
    """``value``: the metric names, then each row's values, parted by blanks."""
    names = summary.sparkSession.createDataFrame([(0, " ".join(summary.columns))], "k int, value string")
    rows = summary.select(F.lit(1).alias("k"), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in summary.columns]).alias("value"))
    return names.unionByName(rows)


def latex_rows(summary: DataFrame, label: str, digits: int = 2) -> DataFrame:
    """``value``: rows of a table, values in percent."""
    numbers = [F.format_number(F.col(c) * 100, digits) for c in summary.columns if c != label]
    return summary.select(F.concat(F.concat_ws(" & ", F.col(label), *numbers), F.lit(r" \\")).alias("value"))


def write_detailed(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def pose_documents(poses: DataFrame, sequences: DataFrame, keep_ids: bool = False) -> DataFrame:
    """``seq, json``: one document for each of ``sequences(seq)``, those without poses included.

    ``poses(seq, image_id, track_id, joints)``; without ``keep_ids`` each pose gets a running number in its sequence.
    """
    number = F.row_number().over(Window.partitionBy("seq").orderBy("image_id", "track_id")) - 1
    rows = poses.withColumn("number", F.col("track_id") if keep_ids else number.cast("long"))
    numbers = F.flatten(F.transform("joints", lambda j: F.array(j["x"], j["y"], j["score"])))
    document = rows.select("seq", F.struct("image_id", F.col("number").alias("track_id"), numbers.alias("keypoints"), F.transform("joints", lambda j: j["score"]).alias("scores")).alias("a"))
    made = document.groupBy("seq").agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    return sequences.select("seq").distinct().join(made, "seq", "left").select("seq", F.to_json(F.struct(F.coalesce("annotations", F.expr("array()")).alias("annotations"))).alias("json"))
