"""From detected items to narratives, belief networks and campaigns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions.lineage import cut
from storyweft.functions.text import ENTITY_PATTERNS, entities, is_claim, iso_time, sentences

KEY = "narrative_id"


def link_to_narrative(items: DataFrame, matches: DataFrame, narratives: DataFrame, verbs: Sequence[str] = (), known_nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Outcome of a batch of detected items (item_id, text, language, confidence, at) given their matches (item_id, narrative_id, similarity).

    ``links``: each item's narrative, new ones named after the first item with that text; ``updated``:
    matched narratives with their last update and highest confidence; ``created``: new narratives, titled
    by the first claim of their text (a sentence with a number or one of ``verbs``), else by the text;
    ``nodes``: belief nodes (node_type, content) to add, for new and matched narratives that have none
    among the known ones, and for each item that matched; ``edges``: those items support the narrative, weighted by
    similarity. Every item is judged by the narratives before the batch, so its order doesn't matter.
    """
    matches = cut(matches)  # a small row each, read by every result
    joined = items.withColumn("h", F.sha2("text", 256)).join(matches, "item_id", "left")
    # The smallest item of each text is aggregated and joined back by the text's digest, so a text that many items share is no one task.
    firsts = joined.filter(F.col(KEY).isNull()).groupBy("language", "h").agg(F.min("item_id").alias("first")).select(F.col("language").alias("l"), F.col("h").alias("k"), "first")
    joined = joined.join(firsts, F.col(KEY).isNull() & F.col("language").eqNullSafe(F.col("l")) & F.col("h").eqNullSafe(F.col("k")), "left")
    links = joined.select("item_id", F.coalesce(F.col(KEY), -F.col("first") - 1).alias(KEY), F.col(KEY).isNull().alias("is_new"), "similarity")
    matched = items.select("item_id", "confidence", "at", F.substring("text", 1, 200).alias("content")).join(matches, "item_id")
    hit = matched.groupBy(KEY).agg(F.max("at").alias("seen"), F.max("confidence").alias("sure"))
    updated = narratives.join(hit, KEY).select(KEY, F.greatest("last_updated", "seen").alias("last_updated"), F.greatest("confidence_score", "sure").alias("confidence_score"))
    new = joined.filter(F.col(KEY).isNull()).groupBy("first", "language", "text").agg(F.max("confidence").alias("confidence_score"), F.min("at").alias("first_detected"), F.max("at").alias("last_updated"))
    claims = F.filter(sentences(F.col("text")), lambda s: is_claim(s, verbs))
    title = F.substring(F.when(F.size(claims) > 0, F.element_at(claims, 1)).otherwise(F.col("text")), 1, 100)
    created = new.select((-F.col("first") - 1).alias(KEY), title.alias("title"), F.substring("text", 1, 500).alias("description"), "language", "confidence_score", "first_detected", "last_updated")
    edges = matched.select(F.col("item_id").alias("a"), F.col(KEY).alias("b"), F.lit("supports").alias("relation"), F.col("similarity").alias("weight"))
    titles = created.select("title").unionByName(narratives.join(hit, KEY, "left_semi").select("title")).select(F.lit("narrative").alias("node_type"), F.col("title").alias("content")).distinct()
    if known_nodes is not None:
        titles = titles.join(known_nodes.select("node_type", "content"), ["node_type", "content"], "left_anti")
    nodes = titles.unionByName(matched.select(F.lit("instance").alias("node_type"), "content"))
    return {"links": links, "updated": updated, "created": created, "nodes": nodes, "edges": edges}


def belief_network(narratives: DataFrame, similar: DataFrame, known_nodes: DataFrame, known_edges: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) to add: a node for each active narrative that has none, and an edge 'similar' for each pair of them above a limit that isn't there in either direction."""
    from storyweft.operators.joins import new_edges

    narratives = narratives.filter("status = 'active'")
    live = narratives.select(F.col(KEY).alias("node")).distinct()
    similar = similar.join(live.withColumnRenamed("node", "a"), "a", "left_semi").join(live.withColumnRenamed("node", "b"), "b", "left_semi")
    nodes = narratives.select(F.col(KEY).alias("node")).distinct().join(known_nodes.select("node"), "node", "left_anti")
    strong = similar.filter(F.col("similarity") > least)
    fresh = new_edges(strong.select("a", "b"), known_edges.select("a", "b"))
    edges = fresh.join(strong.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").alias("weight")), ["a", "b"]).withColumn("relation", F.lit("similar"))
    return nodes, edges.select("a", "b", "relation", "weight")


def campaigns_by_text(clusters: DataFrame, narratives: DataFrame, least: int = 2) -> DataFrame:
    """Text clusters of at least ``least`` members: size, span, languages, mean threat; (narrative_id, cluster) with the narratives' facts."""
    rows = clusters.join(narratives, KEY)
    out = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("first_detected").alias("first_detected"), F.max("last_updated").alias("last_updated"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.avg("threat_level").alias("threat"))
    return out.filter(F.col("size") >= least)


def temporal_map(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Cluster members' times (cluster, narrative_id, at), a row each; members whose time isn't ISO 8601 are skipped."""
    parsed = members.select(KEY, iso_time(F.col("at")).alias("at")).filter("at IS NOT NULL")
    return clusters.join(parsed, KEY).select("cluster", KEY, "at")


def entity_rollup(instances: DataFrame, first: int = 20) -> DataFrame:
    """Distinct entities of each class over a narrative's first instances (narrative_id, instance_id, content)."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("instance_id"))
    rows = instances.withColumn("place", place).filter(F.col("place") <= first)
    kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), entities(F.col("content"), kind).alias("found")) for kind in ENTITY_PATTERNS))
    return rows.select(KEY, F.explode(kinds).alias("e")).select(KEY, "e.kind", F.explode("e.found").alias("entity")).distinct()


def run_metrics(runs: DataFrame) -> DataFrame:
    """Rows, errors, mean and longest duration of each agent's cycles (agent, rows, errors, seconds)."""
    return runs.groupBy("agent").agg(F.count(F.lit(1)).alias("cycles"), F.sum("rows").alias("rows"), F.sum("errors").alias("errors"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("longest"))


def alert_details(alerts: DataFrame, narratives: DataFrame) -> DataFrame:
    """Alerts with their narrative's title and status; alerts on narratives that are gone stay."""
    return alerts.join(narratives.select(KEY, "title", "status"), KEY, "left")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The same rows, and an observation of their number and of rows with a null key once they are written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(df.columns[0]).isNull()).alias("errors")), seen
