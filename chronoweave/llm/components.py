"""Connected components of a graph given as a table of edges, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.storage import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node that has an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until only stars are left: the
    number of rounds grows with the logarithm of the number of nodes, a node with very many
    neighbours is only ever aggregated by its minimum, and each round's edges are a written table.
    Self-loops, repeated edges and nulls are left out; an empty table gives an empty one.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = written(e, "cc-edges")
    while not _stars(e):
        new = written(_step(_step(e, True), False).distinct(), "cc-edges")
        drop(e)
        e = new
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return out.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _step(e: DataFrame, large: bool) -> DataFrame:
    """Every node u links its larger neighbours (large) or itself and its smaller ones (small) to the least it knows."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = both.unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u").where("v <> m")
    if large:
        new = joined.where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
    else:
        new = joined.select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
    return new.where("lo < hi")


def _stars(e: DataFrame) -> bool:
    """Is every node either a least one, or linked to one least node only?"""
    sides = e.select(F.col("hi").alias("u"), F.lit(1).alias("up")).unionByName(e.select(F.col("lo").alias("u"), F.lit(0).alias("up")).distinct())
    odd = sides.groupBy("u").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or (n = 1 and least = 0)")
    return odd.limit(1).count() == 0
