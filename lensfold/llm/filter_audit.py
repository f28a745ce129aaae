"""Filter interaction audit with a packed bitmap index.

Each task packs its rows into bitmaps, one for every filter and label; rows are ordered by part and every part begins at a
64-bit word of its own, so the counts of all parts are sums over ranges of words. For each set of filters that went before,
and each filter that comes next, AND-NOT and population counts say what the filter removes; tasks send these counts, and
their sums over all tasks give every order of the filters.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensfold.llm.common import blobs, column, save, text_slices

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a UTF-8 character
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(blob: bytes, size: int = 1 << 22) -> tuple[int, int]:
    """Words of a text and distinct words; a long text is cut at white space, so that only its distinct words are held."""
    n, seen, start = 0, set(), 0
    while start < len(blob):
        cut = _SPACE.search(blob, start + size) if len(blob) - start > size else None
        end = cut.end() if cut else len(blob)
        words = blob[start:end].split()
        n, start = n + len(words), end
        seen.update(words)
    return n, len(seen)


def text_failures(blob: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    words, distinct = word_counts(blob)
    capitals, points = len(blob) - len(blob.translate(None, _UPPER)), len(blob.translate(None, _INNER))
    symbols = len(blob.translate(None, _SYMBOLS)) < len(blob)
    return (words < 200) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | symbols << 3


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, fails, good, toxic`` for every row of ``docs(doc_id, text, source)``, with ``labels(doc_id, quality, toxic)``.

    ``fails`` has bit k for the k-th of FILTERS. E: the same text (by SHA-256) stands in a row of a smaller doc_id. Null text
    is empty text; a null source is the part ``""``; a null doc_id is not smaller than others, never fails E and has no
    labels; of several labels of a doc_id one is enough. Texts do not leave the scan, only their digests.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [b or b"" for b in blobs(batch, "text")]
            fails = pa.array([text_failures(b) for b in texts], pa.int32())
            keys = pa.array([hashlib.sha256(b).digest() for b in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), keys, fails], ["doc_id", "part", "key", "fails"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = save(own.mapInArrow(judge, "doc_id long, part string, key binary, fails int"))
    # The small sides are written too: a join of plain scans splits the partition of a text or an id that very many rows share.
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = save(first.select("key", "first"))
    is_one = lambda c: F.max(F.col(c).eqNullSafe(1)).alias(c)
    marks = save(labels.filter("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality"), is_one("toxic")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    joined = rows.join(first, "key", "left").join(marks, "doc_id", "left")
    known = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return joined.select("part", F.col("fails").bitwiseOR(copy * 16).alias("fails"), known("quality", "good"), known("toxic", "toxic"))


class Bitmaps:
    """Packed bitmaps of some rows: ``words[k]`` has the rows with bit k of ``flags``; part p owns the words from ``starts[p]``."""

    def __init__(self, parts: np.ndarray, n_parts: int, flags: np.ndarray, n_flags: int):
        self.sizes = np.bincount(parts, minlength=n_parts)
        n_words = -(-self.sizes // 64)
        self.starts = np.cumsum(n_words) - n_words
        order = np.argsort(parts, kind="stable")
        place = np.repeat(self.starts * 64 - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(len(parts))
        bits = np.zeros((n_flags, int(n_words.sum()) * 64), bool)
        bits[:, place] = (flags[order] >> np.arange(n_flags)[:, None]) & 1
        self.words = np.packbits(bits, axis=1).view(np.uint64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Set bits of each part; every part has a row, so no range of words is empty."""
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), self.starts)

    def prefix_counts(self, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(set of filters before, next filter, COUNTS of each part) for each of the first ``n`` bitmaps; two labels follow them."""
        good, toxic = self.words[n], self.words[n + 1]
        for before in range(1 << n):
            gone = np.bitwise_or.reduce(self.words[[k for k in range(n) if before >> k & 1]], axis=0) if before else np.zeros_like(good)
            for k in range(n):
                if not before >> k & 1:
                    hit = self.words[k] & ~gone
                    kept = self.sizes - self.count(gone | hit)
                    yield before, k, [kept, self.count(hit), self.count(self.words[k] & gone), self.count(hit & good), self.count(hit & toxic)]


def prefix_counts(rows: DataFrame, filters: str = FILTERS, hold: int = 1 << 20) -> DataFrame:
    """``part, before, next`` and COUNTS: for every set of filters (bits of ``before``) and filter that may come next.

    ``rows`` are ``part, fails, good, toxic`` as :func:`failures` returns them. A task packs ``hold`` rows at a time and
    sends one row a part and pair, so neither many rows of one part nor many parts need more memory. No rows give no parts.
    """
    n = len(filters)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= hold):
                yield from counted(pa.Table.from_batches(held).combine_chunks())
                held = []

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        parts = table["part"].combine_chunks().dictionary_encode()
        parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
        flags = table["fails"].to_numpy().astype(np.int64)
        for k, label in enumerate(("good", "toxic")):
            flags |= table[label].to_numpy().astype(np.int64) << (n + k)
        maps = Bitmaps(parts.indices.to_numpy(), len(parts.dictionary), flags, n + 2)
        names, width = parts.dictionary, len(parts.dictionary)
        for before, k, counts in maps.prefix_counts(n):
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(np.full(width, before, np.int32)), pa.array(np.full(width, k, np.int32)), *map(pa.array, counts)],
                ["part", "before", "next", *COUNTS],
            )

    found = rows.mapInArrow(index, f"part string, before int, next int, {', '.join(f'{c} long' for c in COUNTS)}")
    return found.groupBy("part", "before", "next").agg(*(F.sum(c).alias(c) for c in COUNTS))


def filter_orders(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step``, COUNTS, ``unique_fails`` and ``shapley``: every order of the filters over every part.

    ``shapley`` is what the step's filter removes, summed over all orders: a set of s filters goes before it in
    s! (n - 1 - s)! orders. ``unique_fails`` is what it removes after all others. The table of orders has n! * n rows.
    """
    n = len(filters)
    sets = [
        ("".join(order), step + 1, sum(1 << filters.index(f) for f in order[:step]), filters.index(order[step]))
        for order in itertools.permutations(filters)
        for step in range(n)
    ]
    orders = rows.sparkSession.createDataFrame(sets, "filter_order string, step int, before int, next int")
    weights = F.array(*(F.lit(math.factorial(b.bit_count()) * math.factorial(max(0, n - 1 - b.bit_count()))) for b in range(1 << n)))
    others = F.lit((1 << n) - 1) - F.call_function("shiftleft", F.lit(1), F.col("next"))
    of_filter = Window.partitionBy("part", "next")
    shared: dict[str, Column] = {
        "shapley": F.sum(F.col("removed") * F.get(weights, F.col("before"))).over(of_filter),
        "unique_fails": F.max(F.when(F.col("before") == others, F.col("removed"))).over(of_filter),
    }
    counts = prefix_counts(rows, filters).withColumns(shared)
    return counts.join(F.broadcast(orders), ["before", "next"]).select("part", "filter_order", "step", *COUNTS, "unique_fails", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order of the five filters and step; see :func:`failures` and :func:`filter_orders`."""
    return filter_orders(failures(docs, labels))


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
lowest AS (SELECT text, min(doc_id) AS lowest FROM texts GROUP BY text),
marks AS (
    SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic
    FROM labels GROUP BY doc_id
),
failed AS (
    SELECT part,
        [CAST(len(words) < 200 AS INT),
         CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT),
         CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT),
         CAST(regexp_matches(text, '[#$%&*|]') AS INT),
         CAST(coalesce(doc_id > lowest, false) AS INT)] AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM split JOIN lowest USING (text) LEFT JOIN marks USING (doc_id)
),
kinds AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
    FROM failed GROUP BY part, fails
),
names AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) AS t (i, name)),
orders AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
    FROM names a, names b, names c, names d, names e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
steps AS (SELECT filter_order, seq, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
judged AS (
    SELECT part, filter_order, step, seq[step] AS f, n, n_good, n_toxic, fails[seq[step]] = 1 AS hit, list_sum(fails) = 1 AS alone,
        len(list_filter(seq[1:step - 1], lambda x: fails[x] = 1)) > 0 AS gone
    FROM kinds, steps
),
counted AS (
    SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept,
        coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
        coalesce(sum(n) FILTER (hit AND alone), 0) AS unique_fails,
        coalesce(sum(n_good) FILTER (hit AND NOT gone), 0) AS good_lost,
        coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
    FROM judged GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
