"""Prototype memory of person search: a running unit prototype a person, and a circular queue of vectors of unknown persons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.operators.pivots import vectors_of


def prototypes(rows: DataFrame, momentum: float = 0.5) -> DataFrame:
    """``pid, v, n``: the prototypes after all of ``rows(pid, place, v)`` in the order of ``place``, and how many rows a person has.

    Each row moves its person's prototype to momentum * prototype + (1 - momentum) * v, at length 1; it starts from zero. Rows
    stream through their task in order, so a person may have any number. Zero vectors leave a zero prototype as it is; rows
    with nulls are left out.
    """
    schema = "pid long, v array<double>, n long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prototype, n = None, np.zeros(0), 0
        for batch in batches:
            done = []
            for pid, v in zip(batch.column(0).to_pylist(), vectors_of(batch.column(2)), strict=True):
                if pid != now:
                    if now is not None:
                        done.append((now, prototype, n))
                    now, prototype, n = pid, np.zeros(len(v)), 0
                prototype = momentum * prototype + (1 - momentum) * v
                length = float(np.sqrt(prototype @ prototype))
                prototype, n = prototype / length if length else prototype, n + 1
            yield _rows(done)
        yield _rows([(now, prototype, n)] if now is not None else [])

    def _rows(done: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        pids, vectors, counts = zip(*done, strict=True) if done else ((), (), ())
        arrays = [pa.array(pids, pa.int64()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64())), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["pid", "v", "n"])

    rows = rows.select(F.col("pid").cast("long").alias("pid"), "place", F.col("v").cast("array<double>").alias("v")).dropna()
    return rows.repartition(F.xxhash64("pid")).sortWithinPartitions("pid", "place").mapInArrow(fold, schema)


def circular_queue(rows: DataFrame, size: int, header: int = 0) -> DataFrame:
    """``slot, place, v``: what a queue of ``size`` slots holds after all of ``rows(place, v)``, written from slot ``header`` on in their order.

    Only the last ``size`` rows stay, so these and the number of rows are all that is needed. Places must not repeat.
    """
    n = rows.count()
    last = rows.select("place", "v").orderBy(F.desc("place")).limit(size)
    back = F.row_number().over(Window.orderBy(F.desc("place"))) - 1  # of ``size`` rows
    return last.withColumn("back", back).select(((F.lit(header + n - 1) - F.col("back")) % size).cast("int").alias("slot"), "place", "v")

