"""Embedding near duplicates by spherical-cap filters with structured random product codes.

After a random rotation a vector is cut into blocks; each block has a random codebook, and a filter is one codeword from
each book. A vector's inner product with a filter is the sum of its blocks' products, so the filters inside its cap can be
listed without looking at the others: the blocks are paired, and of each pair only the best sums are combined. A vector's
cap is as wide as holds a fixed number of filters. Vectors meet in the filters that both hold, and are then verified in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import column, grouped, save
from lensfold.llm.components import connected_components, local_labels

BLOCKS = 4


class ProductCode:
    """``turns`` random product codes for vectors of ``dim`` components, with ``size`` codewords a block.

    Each vector takes the cap that holds its ``each`` best filters of every code, so all vectors have equally many chances
    to meet, wherever their blocks' lengths put their sums.
    """

    def __init__(self, dim: int, size: int, turns: int, each: int, seed: int = 4):
        rng = np.random.default_rng([seed, dim, size])
        self.parts = np.array_split(np.arange(dim), BLOCKS)
        self.turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(turns)]
        self.books = [[self._book(rng, size, len(part)) for part in self.parts] for _ in range(turns)]
        self.each = each
        # Of two sorted lists, the best sums are at ranks (i, j) with (i + 1) * (j + 1) <= each.
        self.ranks = np.array([(i, j) for i in range(each) for j in range(each // (i + 1))]).T

    @staticmethod
    def _book(rng: np.random.Generator, size: int, dim: int) -> np.ndarray:
        book = rng.standard_normal((size, dim))
        return book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12)

    @staticmethod
    def _best(sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.argpartition(-sums, n - 1, axis=1)[:, :n] if sums.shape[1] > n else np.broadcast_to(np.arange(sums.shape[1]), sums.shape)
        values = np.take_along_axis(sums, at, 1)
        order = np.argsort(-values, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1), np.take_along_axis(values, order, 1)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The sorted numbers of the filters of each unit vector, one row a vector."""
        out = []
        for at in range(0, len(x), 256):
            found = []
            for turn, books in zip(self.turns, self.books, strict=True):
                z = x[at : at + 256] @ turn
                p = [z[:, part] @ book.T for part, book in zip(self.parts, books, strict=True)]
                n, m = len(z), p[0].shape[1] ** 2
                (i, a), (j, b) = (self._best((p[k][:, :, None] + p[k + 1][:, None, :]).reshape(n, -1), self.each) for k in (0, 2))
                over, _ = self._best(a[:, self.ranks[0]] + b[:, self.ranks[1]], self.each)
                numbers = np.take_along_axis(i[:, self.ranks[0]], over, 1) * m + np.take_along_axis(j[:, self.ranks[1]], over, 1)
                found.append(numbers + len(found) * m * m)
            out.append(np.sort(np.concatenate(found, axis=1), axis=1))
        return np.concatenate(out)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id, node, unit``: the vector at length 1 as float64 bytes and a hash of its given components; null if it cannot link."""
    for batch in batches:
        nodes, units = [], []
        ids = column(batch, "vec_id")
        for i, v in zip(ids.to_pylist(), column(batch, "embedding"), strict=True):
            x = None
            if i is not None and v.is_valid and len(v) and not v.values.null_count:
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                top = np.abs(x).max()
                x = None if not np.isfinite(top) or top == 0 else x / top
            # Signed zeros are equal components.
            nodes.append(None if x is None else xxhash.xxh64_intdigest((np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) + 0.0).tobytes(), 42) - (1 << 63))
            units.append(None if x is None else (x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "node", "unit"])


def _group_links(cosine: float):
    """From rows sorted by task: links between the members of each task's group, counted once over all filters.

    A pair counts in the first filter that both vectors have. Emits, for each member with links, the copies it is linked
    to and one edge to the first member of its local class; pairs themselves are not emitted.
    """

    def one(x: pa.RecordBatch) -> pa.RecordBatch | None:
        size, units = x.num_rows, [np.frombuffer(u) for u in column(x, "unit").to_pylist()]
        dims, side = np.array([len(u) for u in units]), column(x, "side").to_numpy()
        a, b = [], []
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            m = np.stack([units[k] for k in own])
            for at in range(0, len(own), 512):
                u, v = np.nonzero(m[at : at + 512] @ m.T >= cosine)
                ok = u + at < v
                a.append(own[u[ok] + at])
                b.append(own[v[ok]])
        a, b = np.concatenate(a), np.concatenate(b)
        if side.any():  # two blocks of a large group: pairs inside a block belong to its own task
            ok = side[a] != side[b]
            a, b = a[ok], b[ok]
        if not len(a):
            return None
        label, node, many = local_labels(size, a, b), column(x, "node").to_numpy(), column(x, "copies").to_numpy()
        # A pair is counted in the first filter that both of its vectors have; all have equally many.
        filters = column(x, "filters").flatten().to_numpy().reshape(size, -1)
        here, first = column(x, "filter")[0].as_py(), np.empty(len(a), bool)
        for at in range(0, len(a), 4096):
            p, q = filters[a[at : at + 4096]], filters[b[at : at + 4096]]
            common = (p[:, :, None] == q[:, None, :]).any(axis=2)
            first[at : at + 4096] = np.where(common, p, np.iinfo(np.int64).max).min(axis=1) == here
        n = np.bincount(a[first], many[b[first]], size) + np.bincount(b[first], many[a[first]], size)
        own = np.flatnonzero((n > 0) | (label != np.arange(size)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]]), pa.array(n[own].astype(np.int64))], ["u", "v", "n"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in grouped(batches, "task"):
            if task.num_rows > 1 and (found := one(task)) is not None:
                yield found

    return links


def embedding_components(vectors: DataFrame, cosine: float = 0.95, turns: int = 2, per_code: int = 14, bucket: int = 32, max_group: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    Pairs with a cosine of ``cosine`` or more are linked. Copies enter the search once and count each as a link.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id reachable by links and
    ``kept`` marks its row. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    vec_id, link with nothing: 0 links, their own id. Vectors of different length do not link. Rows that repeat an id
    are separate rows. A link is found if its vectors share a filter; with ``turns`` codes and ``per_code`` filters of each,
    more than 99 in 100 pairs at 0.95 do (measured in the tests). Codebooks grow with the table, so that a filter holds about
    ``bucket`` vectors at every size. A filter with more than ``max_group`` vectors is cut into blocks, and each pair of
    blocks is a task of its own.
    """
    rows = save(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_vectors, "vec_id long, node long, unit binary"))
    usable = rows.filter("node is not null")
    each = save(usable.groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    total = each.count()
    size = max(8, int(np.ceil((total * turns * per_code / bucket) ** (1 / BLOCKS))))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                units = [np.frombuffer(u) for u in column(part, "unit").to_pylist()]
                dims = np.array([len(u) for u in units])
                lists: list = [None] * len(units)
                for dim in np.unique(dims).tolist():
                    code = codes.setdefault(dim, None) or codes.__setitem__(dim, ProductCode(dim, size, turns, per_code)) or codes[dim]
                    own = np.flatnonzero(dims == dim)
                    for k, f in zip(own, code.decode(np.stack([units[k] for k in own])), strict=True):
                        lists[k] = f
                yield pa.RecordBatch.from_arrays([column(part, "node"), column(part, "copies"), column(part, "unit"), pa.array(lists, pa.list_(pa.int64()))], ["node", "copies", "unit", "filters"])

    index = save(each.select("node", "copies", "unit").mapInArrow(decode, "node long, copies long, unit binary, filters array<long>"))
    sizes = index.select(F.explode("filters").alias("filter")).groupBy("filter").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / max_group).cast("int")).select("filter", "blocks")
    filed = index.select("*", F.explode("filters").alias("filter")).join(sizes, "filter")
    # Block i of a filter meets each block j: task (i, j) with i <= j, side 0 for the lower block.
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    filed = filed.withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    dealt = filed.select(F.xxhash64("filter", low, high).alias("task"), "filter", F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "node", "copies", "unit", "filters")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    links = save(dealt.mapInArrow(_group_links(cosine), "u long, v long, n long"))
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    classes = connected_components(links.select("u", "v"))
    named = classes.join(each.select("node", "first_id"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("node", "component_id")
    about = each.select("node", "first_id", "copies").join(counts, "node", "left").join(named, "node", "left")
    about = about.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    about = save(about)  # a join of plain scans, whose partitions can be split where many copies share a node
    out = usable.select("vec_id", "node").join(about, "node").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.unionByName(alone)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u
), c AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
