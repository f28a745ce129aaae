"""Evaluation inputs derived from the star tables, in Spark and as SQL fragments that define the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, d: str, kind: str | None = "array<double>") -> DataFrame:
    """``id, pid, cam, v``: the label is the person, the camera follows the id. Vectors are of ``kind``, or as they are stored."""
    v = F.col("embedding") if kind is None else F.col("embedding").cast(kind)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("pid"), (F.col("vec_id") % 6).alias("cam"), v.alias("v"))


def query_gallery(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, queries, gallery): every tenth id is a query."""
    e = embeddings(spark, d)
    return e, e.filter("id % 10 = 0").select("id", "v"), e.filter("id % 10 <> 0").select("id", "v")


EMB = "emb AS (SELECT vec_id AS id, label AS pid, vec_id % 6 AS cam, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = EMB + """, pairs AS (
  SELECT a.id AS q, b.id AS g, list_distance(a.v, b.v) AS d, a.pid = b.pid AS relevant, a.cam = b.cam AS same_cam
  FROM emb a JOIN emb b ON a.id % 10 = 0 AND b.id % 10 <> 0
)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """An event log from user events: hour as frame, user as object, the number in ``props`` as hypothesis."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    frame = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))").cast("long")
    return e.select(
        (F.col("user_id") % 5).cast("string").alias("seq"), frame.alias("frame_id"), F.col("event_id").alias("event"),
        F.when(kind.isin("click", "view"), "MATCH").when(kind == "purchase", "SWITCH").when(kind == "error", "MISS").otherwise("FP").alias("type"),
        F.when(kind != "signup", F.col("user_id")).alias("oid"), F.when(kind != "error", F.get_json_object("props", "$.k").cast("long")).alias("hid"),
        F.when(kind.isin("click", "view", "purchase"), F.col("value") / 500).alias("d"),
    )


LOG = """log AS (
  SELECT (user_id % 5)::VARCHAR AS seq, floor(epoch(ts) / 3600)::BIGINT AS frame_id, event_id AS event,
    CASE WHEN event_type IN ('click', 'view') THEN 'MATCH' WHEN event_type = 'purchase' THEN 'SWITCH' WHEN event_type = 'error' THEN 'MISS' ELSE 'FP' END AS type,
    CASE WHEN event_type <> 'signup' THEN user_id END AS oid,
    CASE WHEN event_type <> 'error' THEN (regexp_extract(props, '"k": *([0-9]+)', 1))::BIGINT END AS hid,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value / 500 END AS d
  FROM events)"""


#: Line items of a task: what a task sorts and joins is some times its line items, so their number is bounded.
TASK_ROWS = 1 << 18


def ground_truth(spark: SparkSession, d: str, ids: bool = True) -> DataFrame:
    """``seq, frame_id, id, x, y, w, h, flag, discount, tax``: a box a line item, an order as frame; ids count inside it. Without ``ids``, these are null and no row is moved."""
    rows = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") % 20)
    # Adaptive execution makes few partitions of many rows out of those of the session, so large tables get their own number.
    parts = -(-rows.count() // TASK_ROWS) if ids else 0
    rows = rows.repartition(parts, "seq", "l_orderkey") if parts > spark.sparkContext.defaultParallelism else rows
    # Dealt by what frames are joined and grouped by later, so that neither moves the rows once more. All else is derived
    # afterwards: what is moved is then the same whichever columns are used, and moved once for all uses in a plan.
    order = Window.partitionBy("seq", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rows.withColumn("id", (F.row_number().over(order) if ids else F.lit(None)).cast("long")).select(
        "seq", F.col("l_orderkey").alias("frame_id"), "id",
        ((F.col("l_partkey") % 97) * 6).cast("double").alias("x"), ((F.col("l_suppkey") % 41) * 9).cast("double").alias("y"), (F.col("l_quantity") + 20).alias("w"), (2 * (F.col("l_quantity") + 20)).alias("h"),
        F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"),
    )


def detections(gt: DataFrame) -> DataFrame:
    """Ground truth that was not returned, shifted and scored; in every seventh frame under other ids."""
    box = gt.filter("flag <> 'R'")
    shifted = box.withColumn("x", F.col("x") + 100 * F.col("discount")).withColumn("y", F.col("y") + 100 * F.col("tax"))
    return shifted.withColumn("score", 1 - F.col("discount") - F.col("tax")).withColumn("id", F.col("id") + F.when(F.col("frame_id") % 7 == 0, 100).otherwise(0))


BOXES = """gt AS (
  SELECT l_orderkey % 20 AS seq, l_orderkey AS frame_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS id,
    ((l_partkey % 97) * 6)::DOUBLE AS x, ((l_suppkey % 41) * 9)::DOUBLE AS y, l_quantity + 20 AS w, 2 * (l_quantity + 20) AS h,
    l_returnflag AS flag, l_discount AS discount, l_tax AS tax, l_partkey AS part
  FROM lineitem
), dt AS (
  SELECT seq, frame_id, id + CASE WHEN frame_id % 7 = 0 THEN 100 ELSE 0 END AS id, x + 100 * discount AS x, y + 100 * tax AS y, w, h, flag, discount, tax, part,
    1 - discount - tax AS score
  FROM gt WHERE flag <> 'R')"""
BOX_PAIRS = BOXES + """, raw AS (
  SELECT g.seq, g.frame_id, g.id AS g_id, d.id AS d_id,
    greatest(0, least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x)) * greatest(0, least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y)) AS inter,
    g.w * g.h AS ga, d.w * d.h AS da, power(g.x - d.x, 2) + power(g.y - d.y, 2) AS d2,
    (greatest(g.x + g.w, d.x + d.w) - least(g.x, d.x)) * (greatest(g.y + g.h, d.y + d.h) - least(g.y, d.y)) AS hull
  FROM gt g JOIN dt d USING (seq, frame_id)
), bp AS (SELECT *, inter / (ga + da - inter) AS iou FROM raw)"""


def image_names(spark: SparkSession, d: str) -> DataFrame:
    """``name, split, width, height`` of an image an order."""
    o = table(spark, d, "orders")
    name = F.format_string("%04d_c%ds%d_%02d_00.jpg", F.col("o_custkey") % 1500, F.col("o_orderkey") % 6 + 1, F.col("o_orderkey") % 3 + 1, F.col("o_orderkey") % 100)
    return o.select(name.alias("name"), F.col("o_orderstatus").alias("split"), (F.col("o_orderkey") % 640 + 64).alias("width"), (F.col("o_custkey") % 480 + 128).alias("height"))


NAMES = """names AS (
  SELECT format('{:04d}_c{:d}s{:d}_{:02d}_00.jpg', o_custkey % 1500, o_orderkey % 6 + 1, o_orderkey % 3 + 1, o_orderkey % 100) AS name, o_orderstatus AS split,
    o_orderkey % 640 + 64 AS width, o_custkey % 480 + 128 AS height FROM orders
), images AS (
  SELECT *, regexp_extract(name, '^([0-9]+)_c([0-9]+)', 1)::BIGINT AS pid, regexp_extract(name, '^([0-9]+)_c([0-9]+)', 2)::BIGINT AS cam FROM names)"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """``run, epoch, step, name, metric`` of a checkpoint a part."""
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("epoch"), (F.col("p_size") * 100).alias("step"), F.format_string("model_epoch_%03d_step_%05d", F.col("p_partkey"), F.col("p_size") * 100).alias("name"), (F.col("p_retailprice") / 1000 + (F.col("p_partkey") * 37 % 101) / 1000).alias("metric"))


RUNS = """runs AS (
  SELECT p_brand AS run, p_partkey AS epoch, p_size * 100 AS step, format('model_epoch_{:03d}_step_{:05d}', p_partkey, p_size * 100) AS name,
    p_retailprice / 1000 + (p_partkey * 37 % 101) / 1000 AS metric FROM part)"""
