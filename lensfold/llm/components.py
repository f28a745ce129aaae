"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import discard, save


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(u, v)`` (two bigints, any direction, repeats and loops allowed) with the smallest node it reaches.

    Returns ``node, component`` for the nodes of non-loop edges. A round replaces each edge by one to the smallest
    neighbour, first towards larger and then towards smaller nodes, which halves distances; the rounds end when the edges
    no longer change. Minima are partial aggregates, written before they are joined: adaptive execution splits the large
    partitions of a join of two plain scans, so a node with very many edges is not gathered in one place. Nulls: such edges are dropped.
    """
    now = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    said = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large)
        discard(lowest)
        lowest = save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v")
        new = save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for done in (lowest, large, now):
            discard(done)
        before, now, said = said, new, _mark(new)
        if before == said:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes under the links ``a[i] - b[i]``."""
    label = np.arange(n)
    if not len(a):
        return label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new
