"""Queries of the vector and cluster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.operators import vectors as V
from storyweft.plans.registry import query
from storyweft.plans.series import _R
from storyweft.sources.tables import Tables

_D = "1 - list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
_C = "x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), centroids AS (SELECT label AS cluster, list(m ORDER BY i) AS vector FROM (SELECT label, i, AVG(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1)"
_NEAR = _C + f", d AS (SELECT vec_id AS id, cluster, ROUND({_D.format('embedding', 'vector')}, 9) AS distance FROM embeddings CROSS JOIN centroids), near AS (SELECT id, arg_min(cluster, (distance, cluster)) AS cluster, MIN(distance) AS distance FROM d GROUP BY 1)"


def _vectors(t: Tables):
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"))


def _centroids(t: Tables):
    return V.mean_vectors(_vectors(t), "cluster").select("cluster", "vector")


@query("k1_knn", f"WITH d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, ROUND({_D.format('q.embedding', 'r.embedding')}, 9) AS distance FROM embeddings q JOIN embeddings r ON r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, id, ROUND(distance, 6) AS distance, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d.distance, id) AS INT) AS rank FROM d QUALIFY rank <= 5")
def _(t: Tables):
    rows = _vectors(t)
    return _R(V.knn(rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), rows, 5), "distance")


@query("f14_vector_functions", "SELECT vec_id, ROUND(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, ROUND(list_distance(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS l2 FROM embeddings")
def _(t: Tables):
    v = F.col("embedding")
    return _R(t.raw("embeddings").select("vec_id", V.norm(v).alias("norm"), V.euclidean(v, F.reverse(v)).alias("l2")), "norm", "l2")


@query("k10_mean_vectors", f"WITH {_C} SELECT cluster, ROUND(vector[1], 6) AS first, ROUND(vector[64], 6) AS last, len(vector) AS dims FROM centroids")
def _(t: Tables):
    return _R(_centroids(t).select("cluster", F.element_at("vector", 1).alias("first"), F.element_at("vector", 64).alias("last"), F.size("vector").cast("long").alias("dims")), "first", "last")


@query("j10_nearest_centroid", f"WITH {_NEAR} SELECT id, cluster, ROUND(distance, 6) AS distance FROM near")
def _(t: Tables):
    return _R(V.nearest_centroid(_vectors(t).drop("cluster"), _centroids(t)), "distance")


@query("k12_assign_or_new", f"WITH {_NEAR} SELECT id, CASE WHEN distance <= 0.6 THEN cluster ELSE -1 END AS cluster, ROUND(distance, 6) AS distance FROM near")
def _(t: Tables):
    return _R(V.assign_or_new(_vectors(t).drop("cluster"), _centroids(t), 0.6), "distance")


@query("k4_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 10 <> 7")
def _(t: Tables):
    rows = _vectors(t).drop("cluster")
    return V.upsert(rows.withColumn("version", F.lit(1)), rows.filter("id % 3 = 0").withColumn("version", F.lit(2)), rows.filter("id % 10 = 7").select("id")).select("id", "version")


@query("k13_micro_clusters", "WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT label, i, COUNT(*) AS n, AVG(v) AS m, AVG(CAST(v AS DOUBLE) * v) AS q FROM x GROUP BY 1, 2), r AS (SELECT label AS cluster, MAX(n) AS n, sqrt(greatest(0.0, SUM(q - m * m))) AS radius FROM s GROUP BY 1) SELECT cluster, n, ROUND(radius, 4) AS radius, MIN(vec_id) AS first_at, MAX(vec_id) AS last_at FROM r JOIN embeddings ON label = cluster GROUP BY 1, 2, 3")
def _(t: Tables):
    rows = _vectors(t).select("cluster", F.col("vector").cast("array<double>").alias("vector"), F.col("id").alias("at"))
    return V.micro_clusters(rows).select("cluster", "n", F.round("radius", 4).alias("radius"), "first_at", "last_at")


@query("k15_cluster_evolution", "WITH f AS (SELECT DISTINCT source_id % 5 AS old, narrative_id % 7 AS new FROM (SELECT DISTINCT source_id, narrative_id FROM shares)) SELECT 'merge' AS kind, new AS cluster, COUNT(*) AS others FROM f GROUP BY new HAVING COUNT(*) > 1 UNION ALL SELECT 'split', old, COUNT(*) FROM f GROUP BY old HAVING COUNT(*) > 1")
def _(t: Tables):
    rows = t.shares.select(F.concat_ws("-", "source_id", "narrative_id").alias("micro"), "source_id", "narrative_id").distinct()
    return V.cluster_evolution(rows.select("micro", (F.col("source_id") % 5).alias("macro")), rows.select("micro", (F.col("narrative_id") % 7).alias("macro")))


@query("k17_time_pyramid", "SELECT instance_id AS id, CAST(level AS INT) AS level, CAST(floor(epoch_us(detected_at) // 1000000 / (3600 * power(2, level))) AS BIGINT) AS \"window\" FROM instances CROSS JOIN (SELECT unnest(range(1, 4)) AS level)")
def _(t: Tables):
    rows = t.instances.select(F.col("instance_id").alias("id"), F.unix_seconds(F.col("detected_at").cast("timestamp")).alias("epoch"))
    return V.time_pyramid(rows, 3600, 3)


@query("k18_dynamic_window", "SELECT greatest(0.5, least(30.0, ROUND(median(days), 6))) AS days FROM (SELECT date_diff('day', CAST(MIN(detected_at) AS DATE), CAST(MAX(detected_at) AS DATE)) AS days FROM instances GROUP BY narrative_id)")
def _(t: Tables):
    return V.dynamic_window(t.instances.groupBy("narrative_id").agg(F.datediff(F.max("detected_at"), F.min("detected_at")).alias("days")))


@query("k19_medoid_assign", f"WITH m AS (SELECT vec_id % 5 AS cluster, embedding AS v, 1 + vec_id % 3 AS weight FROM embeddings WHERE vec_id < 15), d AS (SELECT vec_id AS id, cluster, weight, {_D.format('embedding', 'v')} AS d FROM embeddings CROSS JOIN m), a AS (SELECT id, cluster, ROUND(SUM(d * weight) / SUM(weight), 9) AS d, STDDEV_POP(d) AS sd, MAX(d) AS top FROM d GROUP BY 1, 2), b AS (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, MIN(d) AS distance, arg_min(1 - sd / top, (d, cluster)) AS confidence FROM a GROUP BY 1) SELECT id, CASE WHEN distance <= 0.9 THEN cluster ELSE -1 END AS cluster, ROUND(distance, 6) AS distance, ROUND(confidence, 6) AS confidence FROM b")
def _(t: Tables):
    rows = _vectors(t).drop("cluster")
    medoids = rows.filter("id < 15").select((F.col("id") % 5).alias("cluster"), "vector", (1 + F.col("id") % 3).alias("weight"))
    return _R(V.medoid_assign(rows, medoids, 0.9), "distance", "confidence")


@query("k20_impact", "SELECT label AS cluster, ROUND(0.3 / (1 + exp(-0.1 * (COUNT(*) - 10))) + 0.3 * least(1.0, label * 2 / 10) + 0.2 * 0.5 + 0.1 * 0.5 + 0.1 * label / 20, 6) AS impact FROM embeddings GROUP BY 1")
def _(t: Tables):
    sizes = _vectors(t).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("cluster")
    return _R(sizes.select("cluster", V.impact_score(F.col("n"), c * 2, F.lit(0.5), F.lit(0.5), c / 20).alias("impact")), "impact")


@query("k22_novelty", f"WITH {_C}, n AS (SELECT vec_id AS id, least(1.0, AVG({_D.format('embedding', 'vector')}) / 1.2) AS novelty FROM embeddings CROSS JOIN centroids GROUP BY 1) SELECT id, ROUND(novelty, 6) AS novelty, ROUND(novelty, 6) > 0.84 AS is_novel FROM n")
def _(t: Tables):
    made = _R(V.novelty(_vectors(t), _centroids(t), 1.2), "novelty")
    return made.withColumn("is_novel", F.col("novelty") > 0.84)


@query("w17_drift")
def _(t: Tables):
    return _R(V.drift(_vectors(t).withColumn("at", F.col("id"))), "drift")


@query("k23_k24_confidence", "WITH c AS (SELECT label AS cluster, 0.5 * (1 - label / 10) + 0.3 * (label % 3) / 3 + 0.2 * (label % 2) AS confidence FROM embeddings GROUP BY 1) SELECT cluster, ROUND(confidence, 6) AS confidence, ROUND(confidence, 6) < 0.4 AS escalated FROM c")
def _(t: Tables):
    c = F.col("cluster")
    rows = _vectors(t).select("cluster").distinct().select("cluster", F.round(V.cluster_confidence(c / 10, (c % 3) / 3, c % 2), 6).alias("confidence"))
    return rows.withColumn("escalated", V.escalate(F.col("confidence"), F.lit(0.0), F.lit(0.0)))


@query("k26_feedback", "SELECT narrative_id % 12 AS cluster, instance_id AS id, value AS score FROM instances QUALIFY ROW_NUMBER() OVER (PARTITION BY narrative_id % 12 ORDER BY detected_at DESC, instance_id DESC) <= 50")
def _(t: Tables):
    rows = t.instances.select((F.col("narrative_id") % 12).alias("cluster"), F.col("instance_id").alias("id"), F.col("value").alias("score"), F.col("detected_at").alias("at"))
    return V.recent_feedback(rows).drop("at")


_TWO = "a AS (SELECT vec_id AS id, label AS cluster FROM embeddings), b AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS cluster FROM embeddings), o AS (SELECT a.cluster AS one, b.cluster AS two, COUNT(*) AS c FROM a JOIN b USING (id) GROUP BY 1, 2), j AS (SELECT one, two, c / ((SELECT COUNT(*) FROM a WHERE cluster = one) + (SELECT COUNT(*) FROM b WHERE cluster = two) - c) AS jaccard FROM o)"


def _overlap(t: Tables, least: float):
    a = _vectors(t).select("id", "cluster")
    b = a.select("id", F.when(F.col("id") % 5 == 0, (F.col("cluster") + 1) % 10).otherwise(F.col("cluster")).alias("cluster"))
    return V.member_overlap(a, b, least)


@query("e5_member_overlap", f"WITH {_TWO} SELECT one, two, ROUND(jaccard, 6) AS jaccard FROM j WHERE jaccard > 0.5")
def _(t: Tables):
    return _R(_overlap(t, 0.5), "jaccard")


@query("k29_relationship_map", f"WITH {_TWO} SELECT one, two, ROUND(jaccard, 6) AS jaccard FROM j WHERE jaccard > 0.1")
def _(t: Tables):
    return _R(_overlap(t, 0.1), "jaccard")


_VOTES = "votes AS (SELECT vec_id AS id, label AS cluster, 0.8 AS confidence, 0.4 AS weight FROM embeddings UNION ALL SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE (label + vec_id) % 10 END, 0.7, 0.3 FROM embeddings UNION ALL SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE (label + 1) % 10 END, 0.9, 0.3 FROM embeddings)"


def _votes(t: Tables):
    rows, n, c = _vectors(t), F.col("id"), F.col("cluster")
    one = rows.select("id", c.cast("long").alias("cluster"), F.lit(0.8).alias("confidence"), F.lit(0.4).alias("weight"))
    two = rows.select("id", F.when(n % 3 == 0, -1).otherwise((c + n) % 10).alias("cluster"), F.lit(0.7).alias("confidence"), F.lit(0.3).alias("weight"))
    three = rows.select("id", F.when(n % 4 == 0, -1).otherwise((c + 1) % 10).cast("long").alias("cluster"), F.lit(0.9).alias("confidence"), F.lit(0.3).alias("weight"))
    return one.unionByName(two).unionByName(three)


@query("k27_ensemble_vote", f"WITH {_VOTES}, s AS (SELECT id, cluster, SUM(CAST(confidence AS DOUBLE) * weight) AS vote, AVG(CAST(confidence AS DOUBLE)) AS mean FROM votes WHERE cluster <> -1 GROUP BY 1, 2), b AS (SELECT id, cluster, 0.7 * ROUND(vote, 9) / SUM(vote) OVER (PARTITION BY id) + 0.3 * mean AS confidence FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY ROUND(vote, 9) DESC, cluster) = 1) SELECT id, cluster, ROUND(confidence, 6) AS confidence, FALSE AS is_outlier, confidence < 0.4 AS review FROM b")
def _(t: Tables):
    return _R(V.ensemble_vote(_votes(t)), "confidence")


@query("p12_p13_threat_recommendation", "WITH x AS (SELECT vec_id AS id, vec_id % 60 / 100 AS p, vec_id % 100 / 100 AS c, vec_id % 7 = 0 AS novel FROM embeddings), b AS (SELECT *, least(5, CAST(floor(p * 10) AS INT)) + CASE WHEN novel THEN 1 ELSE 0 END AS base FROM x), t AS (SELECT *, greatest(0, least(5, CASE WHEN c < 0.5 THEN greatest(1, base - 1) ELSE base END)) AS threat FROM b) SELECT id, threat, CASE WHEN threat >= 4 THEN 'high' WHEN threat >= 2 OR novel THEN 'medium' ELSE 'low' END AS priority, CASE WHEN novel OR (c < 0.5 AND threat < 4) THEN 'review' WHEN threat >= 4 THEN 'monitor_and_counter' WHEN threat >= 2 THEN 'monitor' ELSE 'routine' END AS action FROM t")
def _(t: Tables):
    n = F.col("id")
    rows = _vectors(t).select("id", (n % 60 / 100).alias("p"), (n % 100 / 100).alias("c"), (n % 7 == 0).alias("novel"))
    rows = rows.withColumn("threat", V.threat_level(F.col("p"), F.col("c"), F.col("novel")))
    return rows.select("id", "threat", V.recommendation(F.col("threat"), F.col("c"), F.col("novel")).alias("r")).select("id", "threat", "r.priority", "r.action")


@query("k5_kmeans")
def _(t: Tables):
    return V.kmeans(_vectors(t), 5)


@query("k6_dbscan")
def _(t: Tables):
    return V.dbscan(_vectors(t).drop("cluster"), 0.8, 3)


@query("k8_bisecting")
def _(t: Tables):
    return V.bisecting(_vectors(t), 4)
