"""Packing into length buckets whose boundaries minimise padding over the whole corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.llm.common import save


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries (the last is the longest length) with the least total padding.

    Dynamic programming over the sorted distinct lengths: the best cost of the first j lengths in k buckets extends the
    best cost of the first i in k - 1 by one bucket that is padded to length j. Ties go to the earlier cut.
    """
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m = len(x)
    if not m:
        return []
    many, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    big = np.iinfo(np.int64).max // 4
    cost, cuts = np.full(m + 1, big), []
    cost[0] = 0
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, big), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            padded = cost[:j] + x[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            cut[j] = padded.argmin()
            new[j] = padded[cut[j]]
        cost = new
        cuts.append(cut)
    found, j = [], m
    for cut in reversed(cuts):
        found.append(int(x[j - 1]))
        j = int(cut[j])
    return found[::-1]


def pieces(docs: DataFrame, max_len: int) -> DataFrame:
    """``doc_id, piece, n_tokens``: each document's words and one end, cut into pieces of at most ``max_len`` tokens."""
    total = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
    cut = docs.select("doc_id", total.alias("total")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {max_len}"))))
    return cut.select("doc_id", "piece", F.least(F.lit(max_len), F.col("total") - F.col("piece") * max_len).alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = 2048, buckets: int = 16, token_budget: int = 65536, group_rows: int = 100_000) -> DataFrame:
    """Place every document of ``docs(doc_id, text)`` in batches of equal padded length.

    A text's tokens are its words outside ``[\\x20\\x09-\\x0D]`` and one end; null and empty texts are one end. Documents
    longer than ``max_len`` are cut into pieces, none is dropped. The histogram of piece lengths (at most ``max_len``
    rows) is counted over all rows; :func:`best_boundaries` cuts it into ``buckets``, and batches of ``token_budget``
    padded tokens form inside each bucket. Returns ``doc_id, piece, n_tokens, bucket, bucket_len, batch, slot``, where a
    batch is named by (bucket, batch). Rows are numbered inside groups of about ``group_rows`` by a hash of the id, and
    the groups' sizes are summed up before them, so a bucket with most of the rows is not gathered in one task. Repeated
    ids are separate rows; other columns are not read. An empty table gives an empty result.
    """
    cut = save(pieces(docs, max_len))
    histogram = cut.groupBy("n_tokens").count().collect()
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    groups = 1 + sum(r[1] for r in histogram) // group_rows
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(1).cast("long"))
    bucket = F.size(F.filter(edges, lambda b: b < F.col("n_tokens")))
    placed = cut.withColumn("bucket", bucket).withColumn("bucket_len", edges[F.col("bucket")]).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", "part", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "piece", "n_tokens")) - 1
    rows = placed.withColumn("number", number).join(offsets, ["bucket", "part"]).withColumn("number", F.col("number") + F.col("before"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return rows.select("doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.floor(F.col("number") / room).alias("batch"), (F.col("number") % room).alias("slot"))
