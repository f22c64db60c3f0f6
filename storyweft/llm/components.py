"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.storage import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node that it reaches.

    Alternating large-star and small-star steps: each round every node's larger neighbours, then
    its smaller ones, are hung on its smallest neighbour. The rounds grow with the logarithm of the
    longest path; each round's edges are written to the shared folder, which cuts the lineage. A node
    never gathers its neighbours: only its smallest one is aggregated, and joined back.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "components")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        new = stored(small.filter("a <> b").distinct(), "components")
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
