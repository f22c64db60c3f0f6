"""Aggregations over posts, events, labelled content and clusters; all groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "narrative_id"


def half_even(value: Column) -> Column:
    return F.bround(value, 0)


def instance_stats(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """Posts and distinct sources of each narrative."""
    distinct = F.approx_count_distinct("source_id") if approximate else F.count_distinct("source_id")
    return rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("instances"), distinct.alias("sources"))


def propagation(rows: DataFrame) -> DataFrame:
    """Velocity (posts an hour), propagation score and threat level from 0 to 5 (rounded half to even)."""
    m = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("source_id").alias("sources"), F.min("detected_at").alias("first"), F.max("detected_at").alias("last"))
    hours = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 3.6e9
    velocity = F.when(hours > 0, F.col("instances") / hours).otherwise(F.lit(0.0))
    score = 0.4 * F.least(F.lit(1.0), F.col("instances") / 20) + 0.4 * F.least(F.lit(1.0), F.col("sources") / 5) + 0.2 * F.least(F.lit(1.0), F.col("velocity") / 10)
    out = m.withColumn("velocity", velocity).withColumn("score", score)
    return out.select(KEY, "instances", "sources", "velocity", "score", half_even(F.col("score") * 5).cast("int").alias("threat"))


def top_narratives_by_source(events: DataFrame, k: int) -> DataFrame:
    """Each source's k narratives with most events."""
    counts = events.groupBy("source_id", KEY).agg(F.count(F.lit(1)).alias("events"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("events"), KEY))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def eligible_narratives(rows: DataFrame, least: int, limit: int) -> DataFrame:
    """Narratives with enough posts, most first."""
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("instances"))
    return counts.filter(F.col("instances") >= least).orderBy(F.desc("instances"), KEY).limit(limit)


def with_enough(rows: DataFrame, narratives: DataFrame, least: int = 2) -> DataFrame:
    """Narratives that have at least so many posts."""
    enough = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    return narratives.join(enough, KEY, "left_semi")


def counts_by(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each of several columns and in total, in one pass: dimension, value, n."""
    sets = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    bits = {((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - i)): c for i, c in enumerate(columns)}
    name, value = F.lit("total"), F.lit(None).cast("string")
    for g, c in bits.items():
        name, value = F.when(F.col("gid") == g, c).otherwise(name), F.when(F.col("gid") == g, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def source_stats(sources: DataFrame) -> DataFrame:
    """By source type: total, active, inactive, and the sorted set of categories in the configurations."""
    category = F.get_json_object("config", "$.category")
    return sources.groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), F.array_join(F.sort_array(F.collect_set(category)), ",").alias("categories"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables: name, n."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prioritize_clusters(narratives: DataFrame, newest: int = 100, high: int = 4) -> DataFrame:
    """Clusters of the newest narratives that aren't debunked: size, mean threat, mean confidence, threatening ones, members by threat."""
    rows = narratives.filter("status <> 'debunked'").orderBy(F.desc("last_updated"), KEY).limit(newest)
    members = F.sort_array(F.collect_list(F.struct((-F.col("threat_level")).alias("t"), F.col(KEY))))
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("threat_level").alias("threat"), F.avg("confidence_score").alias("confidence"), F.count_if(F.col("threat_level") >= high).alias("high"), F.transform(members, lambda m: m[KEY].cast("string")).alias("m"))
    return out.select("cluster", "size", "threat", "confidence", "high", F.array_join("m", ",").alias("members"))


def influence(links: DataFrame, narratives: int) -> DataFrame:
    """Centrality (share of all links), mean weight and reach (share of narratives) of each end, and their mean."""
    ends = links.select(F.col("a").alias(KEY), F.col("b").alias("other"), "weight").unionByName(links.select(F.col("b").alias(KEY), F.col("a").alias("other"), "weight"))
    total = links.agg(F.count(F.lit(1)).alias("links"))  # one row
    m = ends.groupBy(KEY).agg(F.count(F.lit(1)).alias("own"), F.avg("weight").alias("strength"), F.count_distinct("other").alias("reached")).join(F.broadcast(total))
    out = m.select(KEY, (F.col("own") / F.col("links")).alias("centrality"), "strength", (F.col("reached") / narratives).alias("reach"))
    return out.withColumn("influence", (F.col("centrality") + F.col("strength") + F.col("reach")) / 3)


def evaluation_stats(rows: DataFrame) -> DataFrame:
    """Totals and detection rate, by type of misinformation and overall (type null)."""
    return rows.rollup("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"), F.avg(F.col("detected").cast("int")).alias("rate"))


def detector_accuracy(rows: DataFrame, threshold: float) -> DataFrame:
    """Share of right answers by topic and kind and all their totals."""
    right = (F.col("score") >= threshold) == F.col("truth")
    return rows.cube("topic", "kind").agg(F.count(F.lit(1)).alias("total"), F.avg(right.cast("int")).alias("accuracy"))


def cluster_time_distribution(members: DataFrame) -> DataFrame:
    """Members of each cluster by day."""
    return members.groupBy("cluster", F.to_date("detected_at").alias("day")).agg(F.count(F.lit(1)).alias("members"))


def dimension_similarity(rows: DataFrame, cluster: str, dimensions: Sequence[str]) -> DataFrame:
    """Share of equal pairs in each group by categorical dimension, from value counts; a group with a null is left out."""
    long = rows.unpivot([cluster], list(dimensions), "dimension", "value")
    counts = long.groupBy(cluster, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(cluster, "dimension").agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"), F.bool_or(F.col("value").isNull()).alias("unknown"))
    return out.filter("NOT unknown AND total > 1").select(cluster, "dimension", (F.col("equal") / (F.col("total") * (F.col("total") - 1))).alias("similarity"))


def cluster_growth(members: DataFrame, as_of: str, least: int = 3, band: float = 0.1) -> DataFrame:
    """Mean of the members' growth from the week before last to the last, and its trend."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("detected_at"))
    own = members.groupBy("cluster", KEY).agg(F.count_if(age.between(1, 7)).alias("now"), F.count_if(age.between(8, 14)).alias("before"))
    growth = F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before")).when(F.col("now") > 0, 1.0).otherwise(0.0)
    out = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.avg(growth).alias("growth"), F.sum("now").alias("active")).filter(F.col("members") >= least)
    return out.withColumn("trend", F.when(F.col("growth") > band, "growing").when(F.col("growth") < -band, "shrinking").otherwise("stable"))


def campaign_summary(members: DataFrame) -> DataFrame:
    """Members, first and last time, and mean value of each cluster, largest first."""
    return members.groupBy("cluster").agg(F.count_distinct(KEY).alias("members"), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"), F.avg("value").alias("complexity"))


def effectiveness_series(daily: DataFrame, countered_on: str) -> DataFrame:
    """After a counter message: 1 - count / mean count before, not below 0; 0 without a baseline."""
    day = F.lit(countered_on).cast("date")
    baseline = F.avg(F.when(F.col("day") < day, F.col("n"))).over(Window.partitionBy(KEY))
    rows = daily.withColumn("baseline", baseline).filter(F.col("day") >= day)
    return rows.select(KEY, "day", F.when(F.col("baseline") > 0, F.greatest(F.lit(0.0), 1 - F.col("n") / F.col("baseline"))).otherwise(F.lit(0.0)).alias("effectiveness"))


def latest_by_key(rows: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """The latest value of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, at).alias(value))


def shared_themes(texts: DataFrame, stop_words: Sequence[str], themes: int) -> DataFrame:
    """Themes of five of the most frequent long words each, with every narrative's weight for them."""
    words = texts.select(KEY, F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).filter((F.length("word") > 3) & ~F.col("word").isin(*stop_words))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(themes * 5)
    theme = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).select("word", F.floor(F.col("place") / 5).alias("theme"))
    sizes = texts.select(KEY, F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).alias("words"))
    hits = words.join(F.broadcast(theme), "word").groupBy(KEY, "theme").agg(F.count(F.lit(1)).alias("hits"))
    weight = F.greatest(F.lit(0.1), F.least(F.lit(0.9), 10 * F.col("hits") / (F.col("words") + 1)))
    return hits.join(sizes, KEY).select(KEY, "theme", "hits", weight.alias("weight"))


def compare_dimensions(scores: DataFrame, dimensions: Sequence[str], default: float = 0.0) -> DataFrame:
    """Narratives side by side: mean score of each dimension."""
    return scores.groupBy(KEY).pivot("dimension", list(dimensions)).agg(F.avg("score")).fillna(default)


def comparison_insights(wide: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The dominant dimension of each narrative and the ranking of its dimensions."""
    ranked = F.array_sort(F.array(*(F.struct((-F.round(F.col(d), 6)).alias("s"), F.lit(d).alias("d")) for d in dimensions)))
    return wide.select(KEY, F.element_at(ranked, 1)["d"].alias("dominant"), F.array_join(F.transform(ranked, lambda x: x["d"]), ">").alias("ranking"))


def observed_run(df: DataFrame, name: str, error: Column) -> tuple[DataFrame, object]:
    """The same rows with an observation of row and error counts, filled when the rows are next consumed."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(error).alias("errors")), seen
