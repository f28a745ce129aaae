"""Grouped work in Python without a call from the JVM for each group."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Group = dict[str, np.ndarray]
_OWN: dict[str, str] = {}


def fold_groups(rows: DataFrame, keys: list[str], fn: Callable[[Group], Group | None], schema: str | StructType, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to the columns of each group as arrays; it returns columns of equal length, or None for no rows.

    Rows are dealt by their keys and sorted, so that a group's rows come one after another through Arrow batches of many
    groups. A group is held in memory whole. Keys must not be null.
    """

    def each(held: Group, starts: np.ndarray) -> Group | None:
        ends = np.append(starts[1:], len(held[keys[0]]))
        found = [out for lo, hi in zip(starts, ends, strict=True) if (out := fn({n: v[lo:hi] for n, v in held.items()})) is not None]
        return {n: np.concatenate([f[n] for f in found]) for n in found[0]} if found else None

    return fold_batches(rows, keys, each, schema, order)


def fold_batches(rows: DataFrame, keys: list[str], fn: Callable[[Group, np.ndarray], Group | None], schema: str | StructType, order: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`fold_groups`, for an ``fn`` of the columns of many whole groups and of the places where each of these starts."""
    names = rows.columns
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Group | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            held = new if held is None else {n: np.concatenate((held[n], new[n])) for n in names}
            starts = group_starts(held, keys)
            if len(starts) > 1:
                yield from _apply({n: v[: starts[-1]] for n, v in held.items()}, starts[:-1])
                held = {n: v[starts[-1] :] for n, v in held.items()}
        if held is not None:
            yield from _apply(held, group_starts(held, keys))

    def _apply(held: Group, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = fn(held, starts)
        if found is not None:
            arrays = [pa.array(found[field.name], field.type, from_pandas=True) for field in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return dealt(rows, keys, order).mapInArrow(run, kind)


def dealt(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each group in one task and its rows one after another.

    Dealt by a hash of the keys: a union of sides that are dealt by the keys counts as dealt by them, even where adaptive
    execution then plans the sides differently, and a shuffle by the keys themselves would be left out.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def group_starts(held: Group, keys: list[str]) -> np.ndarray:
    """Where groups begin in columns that are sorted by ``keys``."""
    n = len(held[keys[0]])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= held[k][1:] != held[k][:-1]
    return np.flatnonzero(new)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if path is None and context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="lensfold-")
    return (path or _OWN[context.applicationId]).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, so that numbers of partitions stay as they are when an executor is lost.

    Files go to :func:`shared_folder`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in :func:`shared_folder`: for large rows that are read more than once."""
    path = f"{shared_folder(df.sparkSession)}/lensfold-rows/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
