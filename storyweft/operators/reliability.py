"""Source reliability from events of misinformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reliability(events: Column) -> Column:
    """100 less 5 for each event, not below 0."""
    return F.greatest(F.lit(0), 100 - F.least(F.lit(100), 5 * events))


def risk_level(score: Column) -> Column:
    """Below 0.3 high, below 0.7 medium, else low."""
    return F.when(score < 0.3, "High").when(score < 0.7, "Medium").otherwise("Low")


def source_scores(events: DataFrame) -> DataFrame:
    """Events and reliability of each source."""
    return events.groupBy("source_id").agg(F.count(F.lit(1)).alias("events")).withColumn("reliability", reliability(F.col("events")))


def reliability_history(events: DataFrame, period: str = "week") -> DataFrame:
    """source_id, period start and mean daily reliability."""
    daily = events.groupBy("source_id", F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.groupBy("source_id", F.date_trunc(period, "day").alias("period")).agg(F.avg(reliability(F.col("n"))).alias("score"))


def trend_of(now: Column, before: Column, band: float) -> Column:
    """Against the previous value, within a relative band."""
    return F.when(now > before * (1 + band), "improving").when(now < before * (1 - band), "declining").otherwise("stable")


def reliability_trend(history: DataFrame, band: float = 0.05) -> DataFrame:
    """Latest score of each source and its direction."""
    w = Window.partitionBy("source_id").orderBy("period")
    rows = history.withColumn("before", F.lag("score").over(w)).withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("period"))))
    return rows.filter("place = 1").select("source_id", "score", trend_of(F.col("score"), F.col("before"), band).alias("trend"))


def detection_ratio(events: DataFrame) -> DataFrame:
    """Share of events judged correct; those not judged count as not correct."""
    return events.groupBy("source_id").agg(F.avg(F.coalesce(F.col("correct_detection"), F.lit(False)).cast("int")).alias("ratio"))


def monthly_events(events: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Events of each source by month, over the last days."""
    recent = events.filter(F.datediff(F.lit(as_of).cast("date"), F.to_date("detected_at")) <= days)
    return recent.groupBy("source_id", F.date_format("detected_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"))


def month_over_month(events: DataFrame, month: str, previous: str) -> DataFrame:
    """Change in per cent between two months; 100 from nothing, 0 without either."""
    name = F.date_format("detected_at", "yyyy-MM")
    counts = events.groupBy("source_id").agg(F.count_if(name == month).alias("current"), F.count_if(name == previous).alias("previous"))
    change = F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) / F.col("previous") * 100).when(F.col("current") > 0, 100.0).otherwise(0.0)
    return counts.withColumn("change_pct", change)


def top_sources(events: DataFrame, month: str, k: int) -> DataFrame:
    """The k sources with most events in a month, with the month's total."""
    counts = events.filter(F.date_format("detected_at", "yyyy-MM") == month).groupBy("source_id").agg(F.count(F.lit(1)).alias("events"))
    total = counts.agg(F.sum("events").alias("total"))  # one row
    return counts.orderBy(F.desc("events"), "source_id").limit(k).join(F.broadcast(total))


def top_risk_sources(history: DataFrame, events: DataFrame, as_of: str, k: int) -> DataFrame:
    """The k least reliable sources: latest reliability as a share, events of 30 days, risk and trend."""
    latest = reliability_trend(history).withColumn("reliability", F.col("score") / 100)
    recent = events.filter(F.datediff(F.lit(as_of).cast("date"), F.to_date("detected_at")) <= 30).groupBy("source_id").agg(F.count(F.lit(1)).alias("recent_events"))
    rows = latest.join(recent, "source_id", "left").withColumn("recent_events", F.coalesce("recent_events", F.lit(0).cast("long")))
    return rows.select("source_id", "reliability", "recent_events", risk_level(F.col("reliability")).alias("risk"), "trend").orderBy("reliability", "source_id").limit(k)
