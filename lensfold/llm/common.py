"""Shared pieces of the corpus operators: the shared folder, text access in Arrow batches, small numpy helpers.

Word rule used by several operators: maximal runs of bytes outside space and ``\\x09-\\x0D``, with A-Z lower-cased.
``bytes.split`` and ``bytes.lower`` are exactly these two rules, so words are handled as UTF-8 bytes.
"""

from __future__ import annotations

import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a local session gets a folder of its own; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="lensfold-")
    return _OWN_DIR[app]


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends here and every executor sees the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lensfold-tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._lensfold_path = path
    return out


def save_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like :func:`save`, as a table bucketed by ``key``: such tables are joined and grouped by it without a shuffle."""
    spark, name = df.sparkSession, f"lensfold_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lensfold-tables/{name}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._lensfold_path, out._lensfold_table = path, name
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of finished shuffles removed: Spark does so when the driver collects what refers to them, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`save` or :func:`save_bucketed`, once nothing will read it again."""
    spark = df.sparkSession
    if table := getattr(df, "_lensfold_table", None):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lensfold_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete all tables that operators have saved. Results that are not written yet become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lensfold-tables")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Shared:
    """A value for all tasks, sent once an executor. Its classes travel with it, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value: object):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        return pickle.loads(self._bytes.value)  # noqa: S301 our own bytes


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def blobs(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of one value each, from rows that come sorted by ``key`` (no nulls)."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        if held and column(held[0], key)[0].as_py() != keys[0]:
            yield joined()
            held.clear()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(keys):
                yield joined()
                held.clear()
    if held:
        yield joined()


def word_blocks(blob: bytes | None, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Lower-cased words, in blocks of about ``size`` bytes so that a very long text never becomes one list."""
    if not blob:
        return
    start = 0
    while start < len(blob):
        end = len(blob)
        if end - start > size and (cut := _SPACE.search(blob, start + size)):
            end = cut.end()
        yield blob[start:end].lower().split()
        start = end


class WordHashes(dict):
    """Word bytes -> signed 64-bit XXH64; filled on demand, emptied when it has ``limit`` entries."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, blob: bytes | None) -> np.ndarray:
        """Hashes of all words of a text, as int64."""
        parts = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in word_blocks(blob)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out, done = np.ones(max(1, n), np.uint64), 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.full(1, pow(base, done, 1 << 64), np.uint64)
        done += take
    return out


_BLOCK, _STEP = 1 << 15, 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_UP, _DOWN = _powers(_STEP, _BLOCK), _powers(_BACK, _BLOCK)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


class Words:
    """The words of some texts side by side: 64-bit ``hashes``, byte places ``starts`` and ``ends`` in ``data``, and how many each text has.

    ``offsets`` are where texts begin and end in ``data``; nulls are empty. A hash is a polynomial in the word's bytes, taken
    as the difference of two prefix sums, so no word is handled on its own.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside, edge = ~_WHITE[self.data], np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        low, high, n = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts), np.uint64), -(-len(self.data) // _BLOCK)
        cuts = np.arange(n + 1) * _BLOCK
        a, b = np.searchsorted(self.starts, cuts), np.searchsorted(self.ends, cuts, side="right")
        up, down = _powers(pow(_STEP, _BLOCK, 1 << 64), n), _powers(pow(_BACK, _BLOCK, 1 << 64), n)
        sums = np.zeros(_BLOCK + 1, np.uint64)
        for k in range(n):
            at = k * _BLOCK
            terms = _LETTER[self.data[at : at + _BLOCK]]
            terms *= _UP[: len(terms)]
            terms *= up[k]
            np.cumsum(terms, out=terms)
            sums[1 : len(terms) + 1] = terms + sums[:1]
            low[a[k] : a[k + 1]] = sums[self.starts[a[k] : a[k + 1]] - at]
            high[b[k] : b[k + 1]] = sums[self.ends[b[k] : b[k + 1]] - at]
            sums[0] = sums[len(terms)]
        return mixed((high - low) * _DOWN[self.starts % _BLOCK] * down[self.starts // _BLOCK]).view(np.int64)

    def lines(self) -> np.ndarray:
        """A number for the line of each word, rising over all texts."""
        return np.searchsorted(np.flatnonzero(self.data == 10), self.starts) + np.repeat(np.arange(len(self.counts)), self.counts)


def byte_slices(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in column ``name`` have about ``size`` bytes together, or that have one text."""
    lengths = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths, dtype=np.int64), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of their texts, so that what a task holds does not depend on the rows of a batch."""
    for batch in batches:
        yield from byte_slices(batch, name, size)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """uint64 hashes of every ``n`` consecutive words; a shorter, non-empty sequence is one shingle."""
    w = words.view(np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    acc = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        acc = (acc * np.uint64(0x9E3779B97F4A7C15)) ^ w[k : len(w) - n + 1 + k]
    return mixed(acc)


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted (keys, counts) pair from several."""
    if len(parts) == 1:
        return parts[0]
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter64:
    """Counts int64 keys in bounded memory: ``add`` gathers, ``flush`` yields sorted (keys, counts) and starts anew."""

    def __init__(self, limit: int = 3_000_000):
        self.raw: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_raw, self.limit = 0, limit

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw >= 1 << 20:
            self._fold()

    def _fold(self) -> None:
        if self.raw:
            self.parts.append(np.unique(np.concatenate(self.raw), return_counts=True))
            self.raw, self.n_raw = [], 0
        if len(self.parts) > 4:
            self.parts = [merged_counts(self.parts)]

    def full(self) -> bool:
        return sum(len(k) for k, _ in self.parts) >= self.limit

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        out = merged_counts(self.parts) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.parts = []
        return out
