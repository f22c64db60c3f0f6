"""Summaries of clusters and of their change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cluster_overview(rows: DataFrame) -> DataFrame:
    """Size, novel members, mean confidence and threat, and the kinds of members of each cluster."""
    return rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("is_novel").alias("novel"), F.avg("confidence_score").alias("confidence"),
        F.avg("threat_level").alias("threat"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )


def cluster_stats(members: DataFrame) -> DataFrame:
    """Members, items and last update of each cluster."""
    return members.groupBy("cluster").agg(F.count_distinct("narrative_id").alias("members"), F.count(F.lit(1)).alias("items"), F.max("detected_at").alias("last_update"))


def evolved_flag(members: DataFrame, since: str, least: int = 10, share: float = 0.5) -> DataFrame:
    """Whether a cluster has more than ``least`` items, and more than a share of them since a time."""
    n = F.count(F.lit(1))
    return members.groupBy("cluster").agg(((n > least) & (F.count_if(F.expr(f"detected_at >= {since}")) > share * n)).alias("evolved"))


def cluster_listing(assigned: DataFrame) -> DataFrame:
    """Each member with its cluster and that cluster's size, a row for each; noise is cluster -1."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return assigned.join(sizes, "cluster").select("cluster", "size", "id")


def stage_deltas(rows: DataFrame) -> DataFrame:
    """By cluster and day: size, and the members (id) added and removed since the day before.

    Members meet their own day before by equality, so no member set is gathered.
    """
    sizes = rows.groupBy("cluster", "day").agg(F.count(F.lit(1)).alias("size"))
    kept = rows.join(rows.select("cluster", "id", F.date_add("day", 1).alias("day")), ["cluster", "id", "day"]).groupBy("cluster", "day").agg(F.count(F.lit(1)).alias("kept"))
    before = sizes.select("cluster", F.date_add("day", 1).alias("day"), F.col("size").alias("before"))
    kept_count = F.coalesce("kept", F.lit(0).cast("long"))
    return sizes.join(before, ["cluster", "day"]).join(kept, ["cluster", "day"], "left").select("cluster", "day", "size", (F.col("size") - kept_count).alias("added"), (F.col("before") - kept_count).alias("removed"))


def macro_clusters(micro: DataFrame, candidates: range) -> DataFrame:
    """(micro, macro): k-means over micro cluster centres weighted by their size, with the k of the best silhouette.

    Micro clusters are few; ``micro`` has cluster, centre and n.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = micro.select(F.col("cluster").alias("micro"), array_to_vector(F.col("centre")).alias("features"), F.col("n").cast("double").alias("n")).cache()
    best, score = None, None
    for k in candidates:
        made = KMeans(k=k, seed=42, maxIter=20, weightCol="n").fit(rows).transform(rows)
        if made.select("prediction").distinct().count() < 2:
            continue
        own = ClusteringEvaluator(weightCol="n").evaluate(made)
        if score is None or own > score:
            best, score = made, own
    out = rows.withColumn("prediction", F.lit(0)) if best is None else best
    return out.select("micro", F.col("prediction").alias("macro"))


def reassign_noise(assigned: DataFrame, vectors: DataFrame, centroids: DataFrame, limit: float) -> DataFrame:
    """(id, cluster) after one more try for noise (-1): the nearest current centre within a limit."""
    from storyweft.operators.vectors import assign_or_new

    noise = vectors.join(assigned.filter("cluster = -1").select("id"), "id", "left_semi")
    retried = assign_or_new(noise, centroids, limit).select("id", F.col("cluster").alias("retried"))
    return assigned.join(retried, "id", "left").select("id", F.coalesce("retried", "cluster").alias("cluster"))


def decayed_medoids(medoids: DataFrame, now: Column, rate: float = 0.05) -> DataFrame:
    """Medoids (cluster, medoid, weight, at) with weights that fall with age in days, and their place in the cluster by weight."""
    days = (F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp"))) / 86400.0
    rows = medoids.withColumn("weight", F.col("weight") * F.exp(-rate * days))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", 9)), "medoid")))


def least_recent(clusters: DataFrame, k: int) -> DataFrame:
    """The k most recently used clusters (cluster, last_updated); older ones make room for new ones."""
    return clusters.orderBy(F.desc("last_updated"), "cluster").limit(k)


def cross_evidence(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Members (id) of two clusterings' clusters that overlap above a limit, as evidence for each other (one, two, id, jaccard)."""
    from storyweft.operators.vectors import member_overlap

    strong = member_overlap(a, b, least)
    both = a.select("id", F.col("cluster").alias("one")).join(b.select("id", F.col("cluster").alias("two")), "id")
    return both.join(strong, ["one", "two"]).select("one", "two", "id", "jaccard")


def daily_clusters(rows: DataFrame, least: int = 3) -> DataFrame:
    """Mean vector of each day's items (id, day, vector) that has at least so many; what day clusters are merged by."""
    from storyweft.operators.vectors import mean_vectors

    return mean_vectors(rows.select("day", "vector"), "day").filter(F.col("size") >= least)


def merged_by_centre(centres: DataFrame, limit: float, metric: str = "cosine") -> DataFrame:
    """(key, cluster): centres (key, vector) whose distance is below a limit share a cluster, named by the smallest key.

    Centres are one for each day or sequence; pairs are found by a checked broadcast list.
    """
    from storyweft.functions.lineage import cut
    from storyweft.operators.graph import connected_components
    from storyweft.operators.vectors import _listed, distance

    centres = cut(centres.select("key", "vector"))
    listed = _listed(centres.select(F.col("key").alias("b"), F.col("vector").alias("v")), 10_000, "centres", "b", "v")
    near = F.filter("listed", lambda c: (c["b"] > F.col("key")) & (F.round(distance(metric, F.col("vector"), c["v"]), 9) < limit))
    pairs = centres.join(F.broadcast(listed)).select(F.col("key").alias("a"), F.explode(near).alias("c")).select("a", "c.b")
    labels = connected_components(pairs).select(F.col("node").alias("key"), "component")
    return centres.select("key").join(labels, "key", "left").select("key", F.coalesce("component", "key").alias("cluster"))


def sequence_clusters(items: DataFrame, gap_hours: float = 24, least: int = 3, limit: float = 0.3) -> DataFrame:
    """Sequences of items (key, id, vector, at) as clusters: (sequence, key, items, cluster, confidence).

    A sequence is a run of a key's items with less than the gap between neighbours, named by its smallest
    id. Sequences whose mean vectors lie less than ``limit`` apart share a cluster, whatever their order;
    confidence is 1 / (1 + distance of the sequence's mean from that of all the cluster's items).
    """
    from storyweft.functions.lineage import cut
    from storyweft.operators.vectors import euclidean, mean_vectors

    w = Window.partitionBy("key").orderBy("at", "id")
    seconds = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    starts = F.coalesce((seconds - F.lag(seconds).over(w) >= gap_hours * 3600).cast("int"), F.lit(1))
    runs = items.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    sizes = runs.groupBy("key", "run").agg(F.min("id").alias("sequence"), F.count(F.lit(1)).alias("items")).filter(F.col("items") >= least)
    rows = cut(runs.join(sizes, ["key", "run"]).select("sequence", "key", "items", F.col("vector").cast("array<double>").alias("vector")))
    means = cut(mean_vectors(rows, "sequence").select("sequence", F.col("vector").alias("mean")))
    merged = cut(merged_by_centre(means.select(F.col("sequence").alias("key"), F.col("mean").alias("vector")), limit, "l2").select(F.col("key").alias("sequence"), "cluster"))
    centres = mean_vectors(rows.join(merged, "sequence"), "cluster").select("cluster", F.col("vector").alias("centre"))
    facts = rows.select("sequence", "key", "items").distinct()
    out = facts.join(merged, "sequence").join(means, "sequence").join(centres, "cluster")
    return out.select("sequence", "key", "items", "cluster", (1 / (1 + euclidean(F.col("mean"), F.col("centre")))).alias("confidence"))


def coordinated_profiles(profiles: DataFrame, radius: float = 1.5, least: int = 3) -> DataFrame:
    """(narrative_id, cluster, size): groups of at least ``least`` narratives with close profiles (narrative_id, p: array).

    Two profiles link when their distance, rounded to nine digits, is at most the radius; groups are the components, whatever
    the order. Equal profiles count as one, the smallest. Blocks of profiles meet in twos and give a spanning forest of their links,
    so no pair is ever a row. Its work is quadratic in the different profiles.
    """
    from storyweft.functions.lineage import cut
    from storyweft.operators.graph import connected_components
    from storyweft.operators.vectors import _density_links, _meet, _usable

    points = cut(profiles.select("narrative_id", F.col("p").cast("array<double>").alias("p")))
    data = cut(_usable(points.groupBy(F.col("p").alias("vector")).agg(F.min("narrative_id").alias("id"))).select("id", "vector", F.lit(True).alias("core")))
    links = cut(_meet(data, _density_links(radius + 5e-10), "a long, b long, d double"))  # as it is: a choice of columns here would take them from the blocks, too
    labels = connected_components(data.select(F.col("id").alias("a"), F.col("id").alias("b")).unionByName(links.select("a", "b")))
    named = data.join(labels.withColumnRenamed("node", "id"), "id").select(F.col("vector").alias("p"), F.col("component").alias("cluster"))
    own = cut(points.join(named, "p").select("narrative_id", "cluster"))
    sizes = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= max(least, 2))
    return own.join(sizes, "cluster").select("narrative_id", "cluster", "size")


def cluster_alerts(unstable: DataFrame, novel: DataFrame, escalated: DataFrame, most: int = 5) -> DataFrame:
    """Alerts (kind, item, at) on all unstable clusters, the newest novel and the newest escalated items."""

    def newest(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "item", "at")

    top = lambda rows: rows.orderBy(F.desc("at"), "item").limit(most)
    return newest(unstable, "stability_alert").unionByName(newest(top(novel), "novelty_alert")).unionByName(newest(top(escalated), "escalation_alert"))


def item_analysis(clusters: DataFrame, votes: DataFrame, most: int = 10) -> DataFrame:
    """Each item's cluster by algorithm (id, algorithm, cluster) with its size and first co-members, and the ensemble's cluster (id, cluster)."""
    sizes = clusters.groupBy("algorithm", "cluster").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.partitionBy("algorithm", "cluster").orderBy("id"))
    first = clusters.withColumn("place", place).filter(F.col("place") <= most + 1).groupBy("algorithm", "cluster").agg(F.sort_array(F.collect_list("id")).alias("first"))  # ``most`` + 1 each
    rows = clusters.join(sizes, ["algorithm", "cluster"]).join(first, ["algorithm", "cluster"])
    others = F.slice(F.filter("first", lambda x: x != F.col("id")), 1, most)
    return rows.join(votes.select("id", F.col("cluster").alias("ensemble")), "id").select("id", "algorithm", "cluster", "size", F.array_join(F.transform(others, lambda x: x.cast("string")), ",").alias("co_members"), "ensemble")


def write_back(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Latest result of each narrative (narrative_id, run_at, cluster) after a run's are appended."""
    return stored.unionByName(results).groupBy("narrative_id").agg(F.max_by("cluster", "run_at").alias("cluster"), F.max("run_at").alias("run_at"))
