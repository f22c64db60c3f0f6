"""Alerts over complexity scores (narrative_id, day, dimension, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "narrative_id"
PRIORITIES = ("critical", "high", "medium", "low")
#: Notification channels by priority (fixed values).
CHANNELS = {"critical": ("email", "sms", "dashboard"), "high": ("email", "dashboard"), "medium": ("dashboard",), "low": ("dashboard",)}


def high_complexity(scores: DataFrame, as_of: str, days: int, overall: float = 7.5, dimension: float = 8.0) -> DataFrame:
    """Recent scores at or above the limit of their dimension."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("day"))
    limit = F.when(F.col("dimension") == "overall", overall).otherwise(dimension)
    return scores.filter(age.between(0, days) & (F.col("score") >= limit))


def exceeded(scores: DataFrame, thresholds: dict[str, float], default: float = 1.0) -> DataFrame:
    """By narrative and day: the dimensions over their thresholds, as a sorted list, and their number."""
    limits = F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))))
    over = F.col("score") >= F.coalesce(F.element_at(limits, F.col("dimension")), F.lit(default))
    return scores.groupBy(KEY, "day").agg(F.sort_array(F.collect_set(F.when(over, F.col("dimension")))).alias("dimensions")).withColumn("exceeded", F.size("dimensions"))


def priority(count: Column, shifted: Column) -> Column:
    """A pattern shift is critical; else by the number of dimensions."""
    return F.when(shifted, "critical").when(count >= 3, "high").when(count == 2, "medium").when(count == 1, "low").otherwise("none")


def message(key: Column, dimensions: Column) -> Column:
    return F.concat(F.lit("Narrative "), key.cast("string"), F.lit(" exceeds its limits in: "), F.array_join(dimensions, ", "))


def channels(level: Column) -> Column:
    out = F.lit("")
    for name, own in CHANNELS.items():
        out = F.when(level == name, ",".join(own)).otherwise(out)
    return out


def by_priority(alerts: DataFrame) -> DataFrame:
    """Alerts by priority, with those that have none."""
    spark = alerts.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, PRIORITIES))).alias("priority"))
    counts = alerts.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "priority", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def newest(alerts: DataFrame, k: int, kind: str | None = None, each: int | None = None) -> DataFrame:
    """The k newest alerts (at, id); of each kind at most ``each``."""
    if kind and each:
        place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("at"), "id"))
        alerts = alerts.withColumn("place", place).filter(F.col("place") <= each).drop("place")
    return alerts.orderBy(F.desc("at"), "id").limit(k)


def notifications(alerts: DataFrame) -> DataFrame:
    """One row per alert and channel."""
    return alerts.select("id", "at", F.explode(F.split("channels", ",")).alias("channel"))
