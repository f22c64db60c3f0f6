"""Queries that compose other operators: listings, lookups, cluster overviews, evolution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.operators import graph as G
from storyweft.operators import series as S
from storyweft.operators.clusters import cluster_listing, cluster_overview, cluster_stats, evolved_flag, stage_deltas
from storyweft.plans.aggregates import _members
from storyweft.plans.registry import query
from storyweft.plans.series import _ENDS, _R, long_scores
from storyweft.sources.tables import AS_OF, Tables


@query("p3_narrative_dict", "SELECT narrative_id, title, status, language, COALESCE(CASE WHEN narrative_id % 4 = 0 THEN NULL ELSE threat_level END, 0) AS threat FROM narratives")
def _(t: Tables):
    threat = F.when(F.col("narrative_id") % 4 != 0, F.col("threat_level"))
    return t.narratives.select("narrative_id", "title", "status", "language", F.coalesce(threat, F.lit(0)).alias("threat"))


@query("p7_unprocessed_queue", "SELECT instance_id FROM instances WHERE narrative_id % 9 = 0 AND detected_at >= TIMESTAMP '2024-01-30 00:00:00'")
def _(t: Tables):
    rows = t.instances.withColumn("narrative_id", F.when(F.col("narrative_id") % 9 != 0, F.col("narrative_id")))
    return rows.filter(F.col("narrative_id").isNull() & F.expr("detected_at >= TIMESTAMP_NTZ '2024-01-31' - INTERVAL 1 DAY")).select("instance_id")


@query("p8_json_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t: Tables):
    return t.raw("events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("p18_forecast_cache_hit", f"WITH l AS (SELECT narrative_id, platform, MAX(detected_at) AS made_at, arg_max(instance_id, detected_at) AS forecast_id FROM instances GROUP BY 1, 2) SELECT narrative_id, platform, forecast_id FROM l WHERE made_at >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY")
def _(t: Tables):
    latest = t.instances.groupBy("narrative_id", "platform").agg(F.max("detected_at").alias("made_at"), F.max_by("instance_id", "detected_at").alias("forecast_id"))
    return latest.filter(F.expr(f"made_at >= TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 2 DAYS")).select("narrative_id", "platform", "forecast_id")


@query("p19_category_tree", "WITH RECURSIVE tree AS (SELECT 2::BIGINT AS id UNION SELECT c.s_suppkey FROM tree JOIN supplier c ON c.s_suppkey // 3 = tree.id AND c.s_suppkey <> tree.id) SELECT s.source_id, s.name FROM sources s JOIN tree ON tree.id = s.source_id")
def _(t: Tables):
    edges = t.sources.select(F.floor(F.col("source_id") / 3).alias("a"), F.col("source_id").alias("b")).filter("a <> b")
    found = G.descendants(edges, t.sources.filter("source_id = 2").select(F.col("source_id").alias("node")))
    return t.sources.join(found.select(F.col("node").alias("source_id")), "source_id", "left_semi").select("source_id", "name")


@query("p22_strategies", "SELECT narrative_id, dimension, CASE dimension WHEN 'emotional' THEN 'reframing,empathy' WHEN 'logical' THEN 'fact check,analogy' ELSE 'clarification' END AS strategies FROM (SELECT DISTINCT narrative_id, dimension FROM scores)")
def _(t: Tables):
    table = F.create_map(F.lit("emotional"), F.lit("reframing,empathy"), F.lit("logical"), F.lit("fact check,analogy"))
    return long_scores(t).select("narrative_id", "dimension").distinct().withColumn("strategies", F.coalesce(F.element_at(table, F.col("dimension")), F.lit("clarification")))


@query("p23_recent_analysis", "WITH n AS (SELECT narrative_id FROM narratives WHERE status = 'active' ORDER BY last_updated DESC, narrative_id LIMIT 50) SELECT narrative_id FROM n WHERE narrative_id IN (SELECT narrative_id FROM scores)")
def _(t: Tables):
    top = t.narratives.filter("status = 'active'").orderBy(F.desc("last_updated"), "narrative_id").limit(50).select("narrative_id")
    return top.join(long_scores(t), "narrative_id", "left_semi")


@query("o4_top_per_group", "SELECT language, narrative_id, CAST(ROW_NUMBER() OVER (PARTITION BY language ORDER BY confidence_score DESC, narrative_id) AS INT) AS place FROM narratives QUALIFY place <= 5")
def _(t: Tables):
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("confidence_score"), "narrative_id"))
    return t.narratives.select("language", "narrative_id", place.alias("place")).filter("place <= 5")


@query("o3_top_by_score", "SELECT narrative_id, ROUND(threat_level * 0.2 + confidence_score, 6) AS score FROM narratives ORDER BY score DESC, narrative_id LIMIT 15")
def _(t: Tables):
    return t.narratives.select("narrative_id", F.round(F.col("threat_level") * 0.2 + F.col("confidence_score"), 6).alias("score")).orderBy(F.desc("score"), "narrative_id").limit(15)


@query("w22_ranks", "SELECT narrative_id, source_id, COUNT(*) AS n, CAST(RANK() OVER w AS INT) AS r, CAST(DENSE_RANK() OVER w AS INT) AS d FROM instances GROUP BY 1, 2 WINDOW w AS (PARTITION BY narrative_id ORDER BY COUNT(*) DESC)")
def _(t: Tables):
    w = Window.partitionBy("narrative_id").orderBy(F.desc("n"))
    counts = t.instances.groupBy("narrative_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.rank().over(w)).withColumn("d", F.dense_rank().over(w))


@query("l2_rapid_change", f"WITH {_ENDS} SELECT narrative_id, dimension, ROUND((last - first) / first * 100, 6) AS change_pct, CASE WHEN last > first THEN 'rise' ELSE 'fall' END AS kind FROM e WHERE points > 1 AND first <> 0 AND abs((last - first) / first * 100) >= 50")
def _(t: Tables):
    rows = S.first_last_change(long_scores(t), 50)
    return _R(rows.select("narrative_id", "dimension", "change_pct", F.when(F.col("last") > F.col("first"), "rise").otherwise("fall").alias("kind")), "change_pct")


@query("s8_newest_per_channel", f"SELECT source_id, instance_id FROM instances WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') <= 14 QUALIFY ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY detected_at DESC, instance_id DESC) <= 10")
def _(t: Tables):
    recent = t.instances.filter(F.datediff(F.lit(AS_OF).cast("date"), F.to_date("detected_at")) <= 14)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("detected_at"), F.desc("instance_id")))
    return recent.withColumn("place", place).filter("place <= 10").select("source_id", "instance_id")


@query("s12_content_items", "SELECT 'page' AS content_type, page_id AS id, url FROM pages UNION ALL SELECT 'document', doc_id, NULL FROM documents")
def _(t: Tables):
    pages = t.raw("pages").select(F.lit("page").alias("content_type"), F.col("page_id").alias("id"), "url")
    return pages.unionByName(t.raw("documents").select(F.lit("document").alias("content_type"), F.col("doc_id").alias("id")), allowMissingColumns=True)


@query("s26_feed_health", "SELECT source_type, CASE WHEN source_id % 7 = 0 THEN 'never checked' WHEN source_id % 5 = 0 THEN 'error' ELSE 'ok' END AS state, COUNT(*) AS feeds FROM sources GROUP BY 1, 2")
def _(t: Tables):
    n = F.col("source_id")
    state = F.when(n % 7 == 0, "never checked").when(n % 5 == 0, "error").otherwise("ok")
    return t.sources.groupBy("source_type", state.alias("state")).agg(F.count(F.lit(1)).alias("feeds"))


@query("a16_cluster_overview", "SELECT narrative_id % 12 AS cluster, COUNT(*) AS size, COUNT(*) FILTER (WHERE narrative_id % 7 = 0) AS novel, ROUND(AVG(confidence_score), 6) AS confidence, ROUND(AVG(threat_level), 6) AS threat, string_agg(DISTINCT language, ',' ORDER BY language) AS kinds FROM narratives GROUP BY 1")
def _(t: Tables):
    rows = t.narratives.select((F.col("narrative_id") % 12).alias("cluster"), (F.col("narrative_id") % 7 == 0).alias("is_novel"), "confidence_score", "threat_level", F.col("language").alias("kind"))
    return _R(cluster_overview(rows), "confidence", "threat")


@query("k34_cluster_stats", "SELECT narrative_id % 12 AS cluster, COUNT(DISTINCT narrative_id) AS members, COUNT(*) AS items, MAX(detected_at) AS last_update FROM instances GROUP BY 1", dates="last_update")
def _(t: Tables):
    return cluster_stats(_members(t))


@query("k35_evolved_flag", f"SELECT narrative_id % 12 AS cluster, COUNT(*) > 10 AND COUNT(*) FILTER (WHERE detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY) > 0.5 * COUNT(*) AS evolved FROM instances GROUP BY 1")
def _(t: Tables):
    return evolved_flag(_members(t), f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 20 DAYS")


@query("k36_cluster_listing", "SELECT cluster, COUNT(*) OVER (PARTITION BY cluster) AS size, id FROM (SELECT vec_id AS id, CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS cluster FROM embeddings)")
def _(t: Tables):
    return cluster_listing(t.raw("embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 6 == 0, -1).otherwise(F.col("label")).alias("cluster")))


@query("w16_k30_stage_deltas", "WITH m AS (SELECT DISTINCT narrative_id % 12 AS cluster, CAST(detected_at AS DATE) AS day, source_id FROM instances), c AS (SELECT cluster, day, COUNT(*) AS size FROM m GROUP BY 1, 2), k AS (SELECT x.cluster, x.day, COUNT(*) AS kept FROM m x JOIN m y ON y.cluster = x.cluster AND y.day = x.day - 1 AND y.source_id = x.source_id GROUP BY 1, 2) SELECT c.cluster, c.day, c.size, c.size - COALESCE(k.kept, 0) AS added, p.size - COALESCE(k.kept, 0) AS removed FROM c JOIN c p ON p.cluster = c.cluster AND p.day = c.day - 1 LEFT JOIN k ON k.cluster = c.cluster AND k.day = c.day", dates="day")
def _(t: Tables):
    rows = t.instances.select((F.col("narrative_id") % 12).alias("cluster"), F.to_date("detected_at").alias("day"), F.col("source_id").alias("id")).distinct()
    return stage_deltas(rows)
