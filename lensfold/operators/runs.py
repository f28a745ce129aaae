"""Experiment logs: best checkpoints, rolling statistics, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.functions.text import percent


def best_so_far(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Add the running best of ``value``, where it was reached first, and whether a row sets it."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = rows.withColumn("best", F.max(value).over(run))
    before = F.lag("best").over(Window.partitionBy(*keys).orderBy(order))
    best = best.withColumn("is_best", before.isNull() | (F.col(value) > before))
    return best.withColumn("best_at", F.last(F.when(F.col("is_best"), F.col(order)), ignorenulls=True).over(run))


def rolling_stats(rows: DataFrame, keys: list[str], order: str, value: str, window: int = 20) -> DataFrame:
    """Add ``median`` (the lower middle), ``avg``, ``max`` and ``last`` of the latest ``window`` values and the ``global_avg`` so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    every = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.array_sort(F.collect_list(value).over(w))
    median = F.element_at(held, F.floor((F.size(held) + 1) / 2).cast("int"))
    return rows.withColumn("median", median).withColumn("avg", F.avg(value).over(w)).withColumn("max", F.max(value).over(w)).withColumn("last", F.col(value)).withColumn("global_avg", F.avg(value).over(every))


def best_checkpoint(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """The checkpoint with the best value of each run; ties by name."""
    best = Window.partitionBy(*keys).orderBy(F.desc(value), name)
    return rows.withColumn("k", F.row_number().over(best)).filter("k = 1").select(*keys, name, value)


def evaluated_epochs(rows: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Checkpoints of epochs 4, 9, 14, ..: epoch mod 5 is 4 or epoch mod 10 is 9."""
    return rows.filter((F.col(epoch) % 5 == 4) | (F.col(epoch) % 10 == 9))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "index") -> DataFrame:
    """Numbers from 1 inside each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def log_results(logs: DataFrame) -> DataFrame:
    """``name, map, rank_1, rank_5, rank_10`` from whole log texts ``logs(name, text)``; null where a log has none."""
    return logs.select("name", percent(F.col("text"), "mAP").alias("map"), *[percent(F.col("text"), rf"Rank-{k}\s").alias(f"rank_{k}") for k in (1, 5, 10)])
