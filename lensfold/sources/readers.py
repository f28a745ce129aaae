"""Scans of annotation, result and log formats as DataFrames. Every reader has a fixed schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensfold.functions.text import clean_attribute, epoch_of, step_of

MOT_NAMES = ("frame_id", "id", "x", "y", "width", "height", "confidence", "class_id", "visibility")
MOT_TYPES = ("long", "long", "double", "double", "double", "double", "double", "int", "double")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("trim(value) <> ''")


def mot_text(spark: SparkSession, path: str, min_confidence: float = -1.0) -> DataFrame:
    """MOTChallenge text, fields parted by blanks, tabs or commas: positions become zero-based, rows below the confidence go."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = _lines(spark, path).select(parts.alias("p"))
    columns = [F.try_element_at("p", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(zip(MOT_NAMES, MOT_TYPES, strict=True))]
    rows = rows.select(*columns).withColumn("x", F.col("x") - 1).withColumn("y", F.col("y") - 1)
    return rows.filter(F.col("confidence") >= min_confidence)


def mot_ground_truth(rows: DataFrame, include_all: bool = False) -> DataFrame:
    """Ground truth that counts: confidence of 1 and the first class."""
    return rows if include_all else rows.filter((F.col("confidence") >= 0.99) & (F.col("class_id") == 1))


def vatic_text(spark: SparkSession, path: str) -> DataFrame:
    """VATIC text: corners become a size, and each attribute that occurs is a boolean column.

    The attribute names are collected first; they are the file's vocabulary of labels.
    """
    p = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).select(p.alias("p"), F.filter(F.regexp_extract_all("value", F.lit('"([^"]*)"'), 0), lambda a: a != "").alias("quoted"))
    n = [F.col("p")[i].try_cast("float") for i in range(10)]
    flag = lambda i: F.col("p")[i].try_cast("int") == 1
    out = rows.select(
        F.col("p")[5].try_cast("long").alias("frame_id"), F.col("p")[0].try_cast("long").alias("id"), n[1].alias("x"), n[2].alias("y"), (n[3] - n[1]).alias("width"), (n[4] - n[2]).alias("height"),
        flag(6).alias("lost"), flag(7).alias("occluded"), flag(8).alias("generated"), F.regexp_replace(F.col("p")[9], '"', "").alias("class_id"),
        F.transform(F.slice("quoted", 2, F.size("quoted")), clean_attribute).alias("attrs"),
    )
    names = [r[0] for r in out.select(F.explode("attrs").alias("a")).distinct().orderBy("a").collect()]
    return out.select(*[c for c in out.columns if c != "attrs"], *[F.array_contains("attrs", a).alias(a) for a in names])


def detrac_xml(spark: SparkSession, path: str) -> DataFrame:
    """UA-DETRAC XML: one row a target of each frame."""
    schema = "_num LONG, target_list STRUCT<target: ARRAY<STRUCT<_id: LONG, box: STRUCT<_left: DOUBLE, _top: DOUBLE, _width: DOUBLE, _height: DOUBLE>, attribute: STRUCT<_vehicle_type: STRING, _truncation_ratio: DOUBLE, _speed: DOUBLE, _orientation: DOUBLE>>>>"
    rows = spark.read.format("xml").option("rowTag", "frame").schema(schema).load(path)
    t = rows.select(F.col("_num").alias("frame_id"), F.explode("target_list.target").alias("t"))
    return t.select("frame_id", F.col("t._id").alias("id"), F.col("t.box._left").alias("x"), F.col("t.box._top").alias("y"), F.col("t.box._width").alias("width"), F.col("t.box._height").alias("height"), F.col("t.attribute._vehicle_type").alias("class_id"), (1 - F.coalesce("t.attribute._truncation_ratio", F.lit(0.0))).alias("visibility"))


def detrac_matrices(spark: SparkSession, path: str) -> DataFrame:
    """UA-DETRAC tables X, Y, W, H (frames by ids) from ``.npz``: centre-bottom becomes top-left, zero cells are absent.

    MATLAB files need a reader that is not part of this environment; convert them to ``.npz`` with the same four names.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content)) as z:
                    x, y, w, h = (np.asarray(z[k], float) for k in "XYWH")
                frame, own = np.nonzero(w * h > 0)
                at = frame, own
                yield pd.DataFrame({"frame_id": frame + 1, "id": own + 1, "x": x[at] - w[at] / 2, "y": y[at] - h[at], "width": w[at], "height": h[at]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "frame_id long, id long, x double, y double, width double, height double")


FORMATS: dict[str, Callable[..., DataFrame]] = {"mot15-2d": mot_text, "mot16": mot_text, "vatic-txt": vatic_text, "detrac-xml": detrac_xml, "detrac-mat": detrac_matrices}


def load(spark: SparkSession, path: str, fmt: str = "mot15-2d", **options) -> DataFrame:
    """A scan by format name."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(sorted(FORMATS))}")
    return FORMATS[fmt](spark, path, **options)


def _replaced(at: int, mapped: Column) -> Callable[[Column, Column], Column]:
    return lambda v, i: F.when(i == at, F.coalesce(F.try_element_at(mapped, v), v)).otherwise(v)


def simple_text(spark: SparkSession, path: str, time: int = 0, ident: int = 1, valid: dict[int, list[float]] | None = None, crowd: dict[int, list[float]] | None = None, convert: dict[int, dict[str, float]] | None = None, drop_negative_ids: bool = False, member: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, crowd rows) of a text whose separator is found per line: ``t, id, fields``.

    ``valid`` keeps rows whose field has one of the values, ``crowd`` sets rows apart, ``convert`` renames values first.
    ``member`` reads a file inside a zip archive.
    """
    if member is None:
        lines = _lines(spark, path)
    else:

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content in pdf.content:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        yield pd.DataFrame({"value": z.read(member).decode().splitlines()})

        lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "value string").filter("trim(value) <> ''")
    p = F.split(F.trim("value"), r"\s*[,;\t]\s*|\s+")
    rows = lines.select(p.alias("p"))
    for at, names in (convert or {}).items():
        mapped = F.create_map(*[F.lit(x) for k, v in names.items() for x in (str(k), str(v))])
        rows = rows.withColumn("p", F.transform("p", _replaced(at, mapped)))
    number = lambda i: F.try_element_at("p", F.lit(i + 1)).try_cast("double")
    for at, values in (valid or {}).items():
        rows = rows.filter(number(at).isin(*[float(v) for v in values]))
    is_crowd = F.lit(bool(crowd))
    for at, values in (crowd or {}).items():
        is_crowd = is_crowd & number(at).isin(*[float(v) for v in values])
    out = rows.select(number(time).cast("long").alias("t"), number(ident).cast("long").alias("id"), F.transform("p", lambda v: v.try_cast("double")).alias("fields"), F.coalesce(is_crowd, F.lit(False)).alias("crowd"))
    kept = out.filter(~F.col("crowd")).drop("crowd")
    return kept.filter("id >= 0") if drop_negative_ids else kept, out.filter("crowd").drop("crowd")


_POSETRACK = "images ARRAY<STRUCT<id: LONG, frame_id: LONG, vid_id: STRING, file_name: STRING, nframes: INT, is_labeled: BOOLEAN, has_labeled_person: BOOLEAN, ignore_regions_x: ARRAY<ARRAY<DOUBLE>>, ignore_regions_y: ARRAY<ARRAY<DOUBLE>>>>, annotations ARRAY<STRUCT<id: LONG, image_id: LONG, track_id: LONG, person_id: LONG, category_id: INT, bbox: ARRAY<DOUBLE>, bbox_head: ARRAY<DOUBLE>, keypoints: ARRAY<DOUBLE>, scores: ARRAY<DOUBLE>>>, categories ARRAY<STRUCT<id: INT, name: STRING>>"


def posetrack(spark: SparkSession, path: str, key: str = "track_id", joints: int = 17) -> tuple[DataFrame, DataFrame]:
    """(images, poses) of PoseTrack JSON documents. A pose's ``id`` is its ``track_id``, or its ``person_id`` for re-identification.

    ``joints`` are structs (x, y, score); a joint's score is the document's, or the third of its numbers.
    """
    doc = spark.read.schema(_POSETRACK).json(path, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    joint = lambda k: F.struct(F.col("keypoints")[3 * k].alias("x"), F.col("keypoints")[3 * k + 1].alias("y"), F.coalesce(F.try_element_at("scores", (k + 1).cast("int")), F.col("keypoints")[3 * k + 2]).alias("score"))
    poses = a.filter(F.size("keypoints") == 3 * joints).select("image_id", F.col("id").alias("ann_id"), F.col(key).alias("id"), "category_id", "bbox", "bbox_head", F.transform(F.sequence(F.lit(0), F.lit(joints - 1)), joint).alias("joints"))
    about = images.select(F.col("id").alias("image_id"), F.col("vid_id").alias("seq"), "frame_id", "is_labeled")
    return images, poses.join(about, "image_id")


def without_joints(joints: Column, dropped: tuple[int, ...] = (3, 4)) -> Column:
    """Joints but for those at the given places."""
    return F.filter(joints, lambda j, i: ~i.isin(*dropped)) if dropped else joints


def mot_sequence(spark: SparkSession, info: str, gt: str, det: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, ground truth, detections) of a sequence's three files; ground truth with confidence 1, frames from 0."""
    image = "file_name STRING, id LONG, frame_id LONG, vid_id STRING, frame_index INT, ignore_regions_x ARRAY<ARRAY<DOUBLE>>, ignore_regions_y ARRAY<ARRAY<DOUBLE>>"
    frames = spark.read.schema(image).json(info, multiLine=True)
    boxes = [mot_text(spark, p).withColumn("frame_index", (F.col("frame_id") - 1).cast("int")).drop("frame_id") for p in (gt, det)]
    about = frames.select("frame_index", F.col("id").alias("image_id"), "vid_id")
    return frames, boxes[0].filter("confidence = 1").join(about, "frame_index"), boxes[1].join(about, "frame_index")


def tracker_results(spark: SparkSession, path: str) -> DataFrame:
    """``track_id, frame, x1, y1, x2, y2``: results from one-based text, zero-based and with corners."""
    r = mot_text(spark, path)
    return r.select(F.col("id").alias("track_id"), (F.col("frame_id") - 1).alias("frame"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}", content: bool = False) -> DataFrame:
    """``name, path, bytes`` of image files; their content only if it is asked for."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return rows.select(name, "path", F.col("length").alias("bytes"), *(["content"] if content else []))


def npz_features(spark: SparkSession, path: str) -> DataFrame:
    """``fname, pid, camid, features`` of feature stores written as ``.npz``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf.content:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["pids"])
                    names = z["fnames"].astype(str) if "fnames" in z else [""] * n
                    cams = z["camids"] if "camids" in z else np.zeros(n, int)
                    yield pd.DataFrame({"fname": names, "pid": z["pids"].astype(int), "camid": cams.astype(int), "features": list(z["features"].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "fname string, pid long, camid long, features array<float>")


def features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ccvid_split(spark: SparkSession, path: str) -> DataFrame:
    """``video_path, person_id, clothes_label`` of lines with three fields; other lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(p.alias("p")).filter(F.size("p") == 3).select(*[F.col("p")[i].alias(n) for i, n in enumerate(("video_path", "person_id", "clothes_label"))])


_COCO = "images ARRAY<STRUCT<id: LONG, file_name: STRING, width: INT, height: INT>>, annotations ARRAY<STRUCT<id: LONG, image_id: LONG, category_id: INT, bbox: ARRAY<DOUBLE>, area: DOUBLE, iscrowd: INT, num_keypoints: INT>>, categories ARRAY<STRUCT<id: INT, name: STRING>>"


def coco(spark: SparkSession, path: str, keep_crowd: bool = False) -> DataFrame:
    """``image_id, file_name, id, category_id, x1, y1, x2, y2, iscrowd``: boxes as corners cut to the image, without empty ones."""
    doc = spark.read.schema(_COCO).json(path, multiLine=True)
    i = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    a = a if keep_crowd else a.filter(F.coalesce("iscrowd", F.lit(0)) == 0)
    b, w, h = [F.col("bbox")[k] for k in range(4)], F.col("width").cast("double"), F.col("height").cast("double")
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    rows = a.join(i, "image_id").select("image_id", "file_name", "id", "category_id", cut(b[0], w).alias("x1"), cut(b[1], h).alias("y1"), cut(b[0] + b[2], w).alias("x2"), cut(b[1] + b[3], h).alias("y2"), F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    return rows.filter("x2 > x1 and y2 > y1")


def voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """``filename, name, x1, y1, x2, y2, difficult`` of Pascal VOC annotations."""
    schema = "filename STRING, object ARRAY<STRUCT<name: STRING, difficult: INT, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    o = rows.select("filename", F.explode("object").alias("o"))
    return o.select("filename", F.col("o.name").alias("name"), F.col("o.bndbox.xmin").alias("x1"), F.col("o.bndbox.ymin").alias("y1"), F.col("o.bndbox.xmax").alias("x2"), F.col("o.bndbox.ymax").alias("y2"), F.coalesce("o.difficult", F.lit(0)).alias("difficult"))


def evaluation_logs(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of whole logs."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


_STATUS = "date STRING, time STRING, status STRING, verbosity STRING, message STRING, epoch INT, step INT, max_epoch INT, max_step INT, time_per_epoch STRING, time_per_step STRING, eta STRING, kpi STRUCT<train_loss: DOUBLE, train_acc: DOUBLE, mAP: DOUBLE>"


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """Status records, one JSON document a line."""
    return spark.read.schema(_STATUS).json(path)


def evaluation_summary(spark: SparkSession, path: str) -> DataFrame:
    """``model, map, rank, value`` of a summary document: a map from models to mAP and cumulative match values."""
    text = spark.read.text(path, wholetext=True)
    models = text.select(F.explode(F.from_json("value", "MAP<STRING, STRUCT<mAP: DOUBLE, cmc: MAP<STRING, DOUBLE>>>")).alias("model", "r"))
    return models.select("model", F.col("r.mAP").alias("map"), F.explode("r.cmc").alias("rank", "value"))


def checkpoints(names: DataFrame) -> DataFrame:
    """``name, epoch, step`` of checkpoint names."""
    return names.select("name", epoch_of(F.col("name")).alias("epoch"), step_of(F.col("name")).alias("step"))


def detailed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A detailed results table; its ``COMBINED`` row is named ``COMBINED_SEQ``."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.withColumn("seq", F.when(F.col("seq") == "COMBINED", "COMBINED_SEQ").otherwise(F.col("seq")))


def frame_numbers(rows: DataFrame) -> DataFrame:
    """Numbers from 1 for the files of each video, by name."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("video").orderBy("file")))
