"""Micro-clusters whose weights fade: cores, and outliers that may grow into cores.

``state`` has (cluster, kind, vector, weight, created, at): a core micro-cluster weighs ``beta * mu`` or more,
any other is an outlier. Weights halve every ``1 / rate`` days. A micro-batch is judged by the state at its
start, so the result doesn't depend on the order of its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions.lineage import cut
from storyweft.operators.vectors import dbscan, nearest_centroid, nearest_within

#: Radius, core share and weight, and rate of fading a day.
EPSILON, BETA, MU, RATE = 0.3, 0.5, 2.5, 0.01
#: How many times faster weights fade at most while posts come faster than usual.
FASTEST = 5.0


def fading_rate(rate: float, items: float, usual: float | None) -> float:
    """The rate for a batch of so many items: faster, up to ``FASTEST`` times, as there are more than usual; never slower."""
    return rate * min(FASTEST, max(1.0, items / usual)) if usual else rate


def _days(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 86_400e6


def faded(state: DataFrame, now: Column, rate: float) -> DataFrame:
    """Weights as they are at a time."""
    return state.withColumn("weight", F.col("weight") * F.pow(F.lit(2.0), -rate * F.greatest(F.lit(0.0), _days(now, F.col("at"))))).withColumn("at", F.greatest(F.col("at"), now))


def least_weight(age: Column, rate: float, beta: float, mu: float) -> Column:
    """What an outlier of an age in days must weigh to stay: nearly nothing at first, and up to ``beta * mu`` if it never becomes a core."""
    if beta * mu <= 1:
        raise ValueError("beta * mu must exceed the weight of one item")
    span = math.ceil(math.log2(beta * mu / (beta * mu - 1)) / rate)
    return (F.pow(F.lit(2.0), -rate * (age + span)) - 1) / (2.0 ** (-rate * span) - 1)


def step(state: DataFrame, batch: DataFrame, epsilon: float = EPSILON, beta: float = BETA, mu: float = MU, rate: float = RATE, usual: float | None = None) -> DataFrame:
    """State after a micro-batch (id, vector, at).

    A row joins the nearest core within ``epsilon``, else the nearest outlier within it; the rest form outliers
    of their own where they lie within ``epsilon`` of one another. Then outliers that weigh enough become cores,
    cores that have faded become outliers, and outliers too light for their age go.
    """
    batch = cut(batch.select("id", F.col("vector").cast("array<double>").alias("vector"), "at"))
    facts = batch.agg(F.max("at").alias("now"), F.count(F.lit(1)).alias("n")).first()  # one row
    if not facts["n"]:
        return state
    own_rate, now = fading_rate(rate, facts["n"], usual), F.lit(facts["now"])
    old = cut(faded(state, now, own_rate))

    def within(rows: DataFrame, kind: str) -> DataFrame:
        return nearest_within(rows, old.filter(F.col("kind") == kind), epsilon).select("id", "cluster")

    cores = cut(within(batch, "core"))
    rest = cut(batch.join(cores, "id", "left_anti"))
    outliers = cut(within(rest, "outlier"))
    new = dbscan(rest.join(outliers, "id", "left_anti").select("id", "vector"), epsilon, 1)
    placed = cores.unionByName(outliers).unionByName(new.select("id", (-F.when(F.col("cluster") == -1, F.col("id")).otherwise(F.col("cluster")) - 2).alias("cluster")))
    rows = batch.join(placed, "id")
    # Sums by dimension, so no cluster's rows are gathered.
    old_sums = old.select("cluster", F.posexplode("vector").alias("i", "x"), F.col("weight").alias("w")).select("cluster", "i", (F.col("x") * F.col("w")).alias("x"), "w")
    sums = old_sums.unionByName(rows.select("cluster", F.posexplode("vector").alias("i", "x")).withColumn("w", F.lit(1.0)))
    means = sums.groupBy("cluster", "i").agg((F.sum("x") / F.sum("w")).alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    facts_of = old.select("cluster", "weight", "created", "at").unionByName(rows.select("cluster", F.lit(1.0).alias("weight"), F.col("at").alias("created"), "at"))
    out = means.join(facts_of.groupBy("cluster").agg(F.sum("weight").alias("weight"), F.min("created").alias("created"), F.max("at").alias("at")), "cluster")
    kind = F.when(F.col("weight") >= beta * mu, "core").otherwise("outlier")
    kept = (kind == "core") | (F.col("weight") >= least_weight(_days(now, F.col("created")), own_rate, beta, mu))
    return cut(out.filter(kept).select("cluster", kind.alias("kind"), "vector", "weight", "created", "at"))


def reassess_outliers(state: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Outliers of a state with the core that they now lie within ``epsilon`` of (null: none) and the distance to the nearest core."""
    outliers = state.filter("kind = 'outlier'").select(F.col("cluster").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    near = nearest_centroid(outliers, state.filter("kind = 'core'").select("cluster", "vector"), "l2")
    return near.select(F.col("id").alias("cluster"), F.when(F.col("distance") <= epsilon, F.col("cluster")).alias("merged_into"), "distance")
