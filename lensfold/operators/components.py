"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.operators.groups import settled


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 60) -> DataFrame:
    """``keys, node, component``: the smallest node that each node of ``edges(keys, u, v)`` reaches; each value of ``keys`` is a graph.

    Nodes may be of any type with an order; direction and repeats do not matter. Rounds of large and small stars: every node
    passes its smallest neighbour first to its larger neighbours, then to its smaller ones, until all edges lead to a node
    that leads nowhere. Each round is four aggregates with partial sums and ends in a reliable checkpoint, so the plan does
    not grow and lost executors cost one round. A node alone appears by a loop; rows with nulls are left out.
    """
    k = list(keys)
    loops = edges.filter("u = v").select(*k, F.col("u").alias("node"), F.col("u").alias("component"))
    now = settled(edges.filter("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*k, "u").agg(F.min("v").alias("m")).select(*k, "u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("u", "v")).alias("u")
        small = large.join(least, [*k, "u"]).select(*k, ends, F.col("m").alias("v")).filter("u <> v")
        now = settled(small.select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if _stars(now, k):
            tips = now.select(*k, F.col("u").alias("node"), F.col("v").alias("component"))
            centres = now.select(*k, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return tips.unionByName(centres).unionByName(loops.join(tips.unionByName(centres), [*k, "node"], "left_anti").distinct())
    raise RuntimeError("components did not settle")


def _stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether each node has one edge to a smaller node, which has none."""
    ends = edges.select(*keys, F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(*keys, F.col("v").alias("n"), F.lit(None).cast("int").alias("up")))
    per = ends.groupBy(*keys, "n").agg(F.count("up").alias("ups"), F.count_if(F.col("up").isNull()).alias("downs"))
    return per.filter("ups > 1 OR (ups > 0 AND downs > 0)").isEmpty()
