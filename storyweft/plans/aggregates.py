"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.operators import aggregates as A
from storyweft.operators import reliability as Q
from storyweft.operators import series as S
from storyweft.plans.registry import query
from storyweft.plans.series import _R, long_scores
from storyweft.sources.tables import AS_OF, DIMENSIONS, Tables

#: Stand-in clusters: narratives by remainder.
_CLUSTERED = "members AS (SELECT narrative_id % 12 AS cluster, narrative_id, detected_at, value FROM instances)"


def _members(t: Tables):
    return t.instances.select((F.col("narrative_id") % 12).alias("cluster"), "narrative_id", "detected_at", "value")


def _evaluations(t: Tables):
    """Labelled documents with a detector's score: topic, kind, truth, score, detected."""
    rows = t.raw("documents").join(t.raw("labels"), "doc_id")
    score = F.col("doc_id") % 101 / 100
    return rows.select(F.col("lang").alias("topic"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("kind"), (F.col("toxic") == 1).alias("truth"), score.alias("score"), (score >= 0.75).alias("detected"))


_EVAL = "evaluations AS (SELECT lang AS topic, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS kind, toxic = 1 AS truth, doc_id % 101 / 100 AS score, doc_id % 101 / 100 >= 0.75 AS detected FROM documents JOIN labels USING (doc_id))"


@query("a2_instance_stats", "SELECT narrative_id, COUNT(*) AS instances, COUNT(DISTINCT source_id) AS sources FROM instances GROUP BY 1")
def _(t: Tables):
    return A.instance_stats(t.instances)


_PROPAGATION = "m AS (SELECT narrative_id, COUNT(*) AS instances, COUNT(DISTINCT source_id) AS sources, (epoch_us(MAX(detected_at)) - epoch_us(MIN(detected_at))) / 3.6e9 AS hours FROM instances GROUP BY 1), v AS (SELECT *, CASE WHEN hours > 0 THEN instances / hours ELSE 0.0 END AS velocity FROM m), prop AS (SELECT narrative_id, instances, sources, velocity, 0.4 * least(1.0, instances / 20) + 0.4 * least(1.0, sources / 5) + 0.2 * least(1.0, velocity / 10) AS score FROM v)"


@query("a3_propagation", f"WITH {_PROPAGATION} SELECT narrative_id, instances, sources, ROUND(velocity, 6) AS velocity, ROUND(score, 6) AS score, CAST(round_even(score * 5, 0) AS INT) AS threat FROM prop")
def _(t: Tables):
    return _R(A.propagation(t.instances), "velocity", "score")


@query("flagship_trending_propagation", f"WITH {_PROPAGATION}, c AS (SELECT narrative_id, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 1 AND 10) AS current, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 11 AND 20) AS previous FROM instances GROUP BY 1), g AS (SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous WHEN current > 0 THEN 1.0 ELSE 0.0 END AS growth FROM c WHERE current + previous > 0 ORDER BY growth DESC, current DESC, narrative_id LIMIT 20) SELECT g.narrative_id, current, previous, ROUND(growth, 6) AS growth, ROUND(score, 6) AS score, CAST(round_even(score * 5, 0) AS INT) AS threat FROM g JOIN prop USING (narrative_id)")
def flagship(t: Tables):
    top = S.trending(t.instances, AS_OF, 10, 20)
    scores = A.propagation(t.instances).select("narrative_id", "score", "threat")
    return _R(top.join(scores, "narrative_id"), "growth", "score")


@query("a4_top_sources_month", "WITH c AS (SELECT source_id, COUNT(*) AS events FROM misinfo_events WHERE strftime(detected_at, '%Y-%m') = '2024-01' GROUP BY 1) SELECT source_id, events, CAST((SELECT SUM(events) FROM c) AS BIGINT) AS total FROM c ORDER BY events DESC, source_id LIMIT 10")
def _(t: Tables):
    return Q.top_sources(t.misinfo_events, "2024-01", 10)


@query("a5_monthly_events", f"SELECT source_id, strftime(detected_at, '%Y-%m') AS month, COUNT(*) AS events FROM misinfo_events WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') <= 180 GROUP BY 1, 2")
def _(t: Tables):
    return Q.monthly_events(t.misinfo_events, AS_OF)


@query("a6_top_narratives_by_source", "WITH c AS (SELECT source_id, narrative_id, COUNT(*) AS events FROM misinfo_events GROUP BY 1, 2), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY events DESC, narrative_id) AS place FROM c) SELECT source_id, narrative_id, events, CAST(place AS INT) AS place FROM o WHERE place <= 5")
def _(t: Tables):
    return A.top_narratives_by_source(t.misinfo_events, 5)


@query("a7_month_over_month", "WITH c AS (SELECT source_id, COUNT(*) FILTER (WHERE strftime(detected_at, '%Y-%m') = '2024-01') AS current, COUNT(*) FILTER (WHERE strftime(detected_at, '%Y-%m') = '2023-12') AS previous FROM misinfo_events GROUP BY 1) SELECT *, CASE WHEN previous > 0 THEN (current - previous) / previous * 100 WHEN current > 0 THEN 100.0 ELSE 0.0 END AS change_pct FROM c")
def _(t: Tables):
    return Q.month_over_month(t.misinfo_events, "2024-01", "2023-12")


@query("a8_reliability_score", "SELECT source_id, COUNT(*) AS events, greatest(0, 100 - least(100, 5 * COUNT(*))) AS reliability FROM misinfo_events GROUP BY 1")
def _(t: Tables):
    return Q.source_scores(t.misinfo_events)


@query("a9_detection_ratio", "SELECT source_id, ROUND(AVG(CASE WHEN COALESCE(correct_detection, FALSE) THEN 1 ELSE 0 END), 6) AS ratio FROM misinfo_events GROUP BY 1")
def _(t: Tables):
    return _R(Q.detection_ratio(t.misinfo_events), "ratio")


@query("a10_eligible_narratives", "SELECT narrative_id, COUNT(*) AS instances FROM instances GROUP BY 1 HAVING COUNT(*) >= 5 ORDER BY instances DESC, narrative_id LIMIT 20")
def _(t: Tables):
    return A.eligible_narratives(t.instances, 5, 20)


@query("a11_min_instances", "SELECT narrative_id, language, status FROM narratives WHERE narrative_id IN (SELECT narrative_id FROM instances GROUP BY 1 HAVING COUNT(*) >= 60)")
def _(t: Tables):
    return A.with_enough(t.instances, t.narratives, 60).select("narrative_id", "language", "status")


@query("a12_counts_by", "SELECT 'status' AS dimension, status AS value, COUNT(*) AS n FROM narratives GROUP BY 2 UNION ALL SELECT 'language', language, COUNT(*) FROM narratives GROUP BY 2 UNION ALL SELECT 'source', source, COUNT(*) FROM narratives GROUP BY 2 UNION ALL SELECT 'total', NULL, COUNT(*) FROM narratives")
def _(t: Tables):
    return A.counts_by(t.narratives, ["status", "language", "source"])


@query("a13_source_stats", """SELECT source_type, COUNT(*) AS total, COUNT(*) FILTER (WHERE is_active) AS active, COUNT(*) FILTER (WHERE NOT is_active) AS inactive, array_to_string(list_sort(list(DISTINCT json_extract_string(config, '$.category'))), ',') AS categories FROM sources GROUP BY 1""")
def _(t: Tables):
    return A.source_stats(t.sources)


@query("a14_table_counts", "SELECT 'instances' AS name, COUNT(*) AS n FROM instances UNION ALL SELECT 'narratives', COUNT(*) FROM narratives UNION ALL SELECT 'sources', COUNT(*) FROM sources")
def _(t: Tables):
    return A.table_counts({"instances": t.instances, "narratives": t.narratives, "sources": t.sources})


@query("a15_prioritize_clusters", "WITH r AS (SELECT *, narrative_id % 7 AS cluster FROM narratives WHERE status <> 'debunked' ORDER BY last_updated DESC, narrative_id LIMIT 100) SELECT cluster, COUNT(*) AS size, ROUND(AVG(threat_level), 6) AS threat, ROUND(AVG(confidence_score), 6) AS confidence, COUNT(*) FILTER (WHERE threat_level >= 4) AS high, string_agg(CAST(narrative_id AS VARCHAR), ',' ORDER BY threat_level DESC, narrative_id) AS members FROM r GROUP BY 1")
def _(t: Tables):
    return _R(A.prioritize_clusters(t.narratives.withColumn("cluster", F.col("narrative_id") % 7)), "threat", "confidence")


@query("a17_influence", "WITH l AS (SELECT DISTINCT source_id % 40 AS a, source_id % 40 + 1 + narrative_id % 7 AS b, (source_id % 40 + narrative_id % 7) % 10 / 10 AS weight FROM shares), e AS (SELECT a AS narrative_id, b AS other, weight FROM l UNION ALL SELECT b, a, weight FROM l), m AS (SELECT narrative_id, COUNT(*) / (SELECT COUNT(*) FROM l) AS centrality, AVG(weight) AS strength, COUNT(DISTINCT other) / 50 AS reach FROM e GROUP BY 1) SELECT narrative_id, ROUND(centrality, 6) AS centrality, ROUND(strength, 6) AS strength, ROUND(reach, 6) AS reach, ROUND((centrality + strength + reach) / 3, 6) AS influence FROM m")
def _(t: Tables):
    a, k = F.col("source_id") % 40, F.col("narrative_id") % 7
    links = t.shares.select(a.alias("a"), (a + 1 + k).alias("b"), ((a + k) % 10 / 10).alias("weight")).distinct()
    return _R(A.influence(links, 50), "centrality", "strength", "reach", "influence")


@query("a18_evaluation_stats", f"WITH {_EVAL} SELECT kind, COUNT(*) AS total, COUNT(*) FILTER (WHERE detected) AS detected, ROUND(AVG(CAST(detected AS INT)), 6) AS rate FROM evaluations GROUP BY ROLLUP (kind)")
def _(t: Tables):
    return _R(A.evaluation_stats(_evaluations(t)), "rate")


@query("a19_detector_accuracy", f"WITH {_EVAL} SELECT topic, kind, COUNT(*) AS total, ROUND(AVG(CAST((score >= 0.75) = truth AS INT)), 6) AS accuracy FROM evaluations GROUP BY CUBE (topic, kind)")
def _(t: Tables):
    return _R(A.detector_accuracy(_evaluations(t), 0.75), "accuracy")


@query("a20_model_accuracy", f"WITH {_EVAL} SELECT topic, kind, ROUND(AVG(score), 6) AS accuracy FROM evaluations GROUP BY GROUPING SETS ((topic), (kind))")
def _(t: Tables):
    rows = _evaluations(t)
    return _R(rows.groupingSets([[F.col("topic")], [F.col("kind")]], "topic", "kind").agg(F.avg("score").alias("accuracy")), "accuracy")


@query("a22_cluster_time_distribution", f"WITH {_CLUSTERED} SELECT cluster, CAST(detected_at AS DATE) AS day, COUNT(*) AS members FROM members GROUP BY 1, 2", dates="day")
def _(t: Tables):
    return A.cluster_time_distribution(_members(t))


@query("a23_dimension_similarity", "WITH l AS (SELECT narrative_id % 12 AS cluster, 'status' AS dimension, status AS v FROM narratives UNION ALL SELECT narrative_id % 12, 'language', language FROM narratives), c AS (SELECT cluster, dimension, v, COUNT(*) AS n FROM l GROUP BY 1, 2, 3) SELECT cluster, dimension, ROUND(SUM(n * (n - 1)) / (SUM(n) * (SUM(n) - 1)), 6) AS similarity FROM c GROUP BY 1, 2")
def _(t: Tables):
    return _R(A.dimension_similarity(t.narratives.withColumn("cluster", F.col("narrative_id") % 12), "cluster", ["status", "language"]), "similarity")


@query("a24_comparison_insights", "WITH m AS (SELECT narrative_id, dimension, ROUND(AVG(score), 6) AS s FROM scores GROUP BY 1, 2) SELECT narrative_id, arg_min(dimension, (-s, dimension)) AS dominant, string_agg(dimension, '>' ORDER BY s DESC, dimension) AS ranking FROM m GROUP BY 1 HAVING COUNT(*) = 5")
def _(t: Tables):
    complete = long_scores(t).groupBy("narrative_id").agg(F.count_distinct("dimension").alias("d")).filter("d = 5")
    wide = A.compare_dimensions(long_scores(t).join(complete, "narrative_id", "left_semi"), DIMENSIONS)
    return A.comparison_insights(wide, DIMENSIONS)


@query("a26_compare_dimensions", "SELECT narrative_id, " + ", ".join(f"ROUND(COALESCE(AVG(score) FILTER (WHERE dimension = '{d}'), 0.0), 6) AS {d}" for d in DIMENSIONS) + " FROM scores GROUP BY 1")
def _(t: Tables):
    return _R(A.compare_dimensions(long_scores(t), DIMENSIONS), *DIMENSIONS)


_STOP = ("with", "that", "this", "from", "para", "pour", "dans", "sich")


@query("a25_shared_themes", f"""WITH w AS (SELECT narrative_id, unnest(string_split_regex(lower(description), '[^\\p{{L}}]+')) AS word FROM narratives), k AS (SELECT * FROM w WHERE length(word) > 3 AND word NOT IN {_STOP}), t AS (SELECT word, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, word) - 1 AS place FROM k GROUP BY 1 QUALIFY place < 15), h AS (SELECT narrative_id, place // 5 AS theme, COUNT(*) AS hits FROM k JOIN t USING (word) GROUP BY 1, 2), s AS (SELECT narrative_id, len(list_filter(string_split_regex(description, '\\s+'), lambda x: x <> '')) AS words FROM narratives) SELECT narrative_id, theme, hits, ROUND(greatest(0.1, least(0.9, 10 * hits / (words + 1))), 6) AS weight FROM h JOIN s USING (narrative_id)""")
def _(t: Tables):
    return _R(A.shared_themes(t.narratives.select("narrative_id", F.col("description").alias("text")), _STOP, 3), "weight")


@query("a27_top_risk_sources", f"""WITH m AS (SELECT source_id, date_trunc('week', CAST(day AS TIMESTAMP)) AS week, AVG(greatest(0, 100 - 5 * n)) AS score FROM (SELECT source_id, CAST(detected_at AS DATE) AS day, COUNT(*) AS n FROM misinfo_events GROUP BY 1, 2) GROUP BY 1, 2), r AS (SELECT *, LAG(score) OVER (PARTITION BY source_id ORDER BY week) AS before, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY week DESC) AS k FROM m), n AS (SELECT source_id, COUNT(*) AS recent_events FROM misinfo_events WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') <= 30 GROUP BY 1) SELECT source_id, ROUND(score / 100, 6) AS reliability, COALESCE(recent_events, 0) AS recent_events, CASE WHEN score / 100 < 0.3 THEN 'High' WHEN score / 100 < 0.7 THEN 'Medium' ELSE 'Low' END AS risk, CASE WHEN score > before * 1.05 THEN 'improving' WHEN score < before * 0.95 THEN 'declining' ELSE 'stable' END AS trend FROM r LEFT JOIN n USING (source_id) WHERE k = 1 ORDER BY score / 100, source_id LIMIT 10""")
def _(t: Tables):
    return _R(Q.top_risk_sources(Q.reliability_history(t.misinfo_events), t.misinfo_events, AS_OF, 10), "reliability")


@query("a28_pattern_stats", "WITH c AS (SELECT narrative_id, day, CASE WHEN n >= 5 THEN 'spike' ELSE 'level' END AS kind, n / 10 AS confidence FROM daily) SELECT kind, COUNT(*) AS patterns, COUNT(*) FILTER (WHERE confidence >= 0.4) AS confident, ROUND(AVG(confidence), 6) AS mean FROM c GROUP BY 1")
def _(t: Tables):
    rows = t.daily.select(F.when(F.col("n") >= 5, "spike").otherwise("level").alias("kind"), (F.col("n") / 10).alias("confidence"))
    return _R(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("confidence") >= 0.4).alias("confident"), F.avg("confidence").alias("mean")), "mean")


@query("a30_cluster_growth", f"WITH {_CLUSTERED}, o AS (SELECT cluster, narrative_id, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 1 AND 7) AS now, COUNT(*) FILTER (WHERE date_diff('day', CAST(detected_at AS DATE), DATE '{AS_OF}') BETWEEN 8 AND 14) AS before FROM members GROUP BY 1, 2), g AS (SELECT cluster, COUNT(*) AS members, AVG(CASE WHEN before > 0 THEN (now - before) / before WHEN now > 0 THEN 1.0 ELSE 0.0 END) AS growth, CAST(SUM(now) AS BIGINT) AS active FROM o GROUP BY 1 HAVING COUNT(*) >= 3) SELECT cluster, members, ROUND(growth, 6) AS growth, active, CASE WHEN growth > 0.1 THEN 'growing' WHEN growth < -0.1 THEN 'shrinking' ELSE 'stable' END AS trend FROM g")
def _(t: Tables):
    return _R(A.cluster_growth(_members(t), AS_OF), "growth")


@query("a31_campaign_summary", f"WITH {_CLUSTERED} SELECT cluster, COUNT(DISTINCT narrative_id) AS members, MIN(detected_at) AS first_at, MAX(detected_at) AS last_at, ROUND(AVG(value), 6) AS complexity FROM members GROUP BY 1", dates="first_at last_at")
def _(t: Tables):
    return _R(A.campaign_summary(_members(t)), "complexity")


@query("a32_effectiveness_series", "WITH b AS (SELECT *, AVG(n) FILTER (WHERE day < DATE '2024-01-20') OVER (PARTITION BY narrative_id) AS baseline FROM daily) SELECT narrative_id, day, ROUND(CASE WHEN baseline > 0 THEN greatest(0.0, 1 - n / baseline) ELSE 0.0 END, 6) AS effectiveness FROM b WHERE day >= DATE '2024-01-20'", dates="day")
def _(t: Tables):
    return _R(A.effectiveness_series(t.daily, "2024-01-20"), "effectiveness")


@query("a33_merge_effectiveness", "SELECT narrative_id, platform, arg_max(value, (detected_at, instance_id)) AS value FROM instances GROUP BY 1, 2")
def _(t: Tables):
    rows = t.instances.withColumn("at", F.struct("detected_at", "instance_id"))
    return A.latest_by_key(rows, ["narrative_id", "platform"], "value", "at")
