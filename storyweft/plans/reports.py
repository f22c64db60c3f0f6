"""Queries of alerts, exports, evidence, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.operators import alerts as L
from storyweft.operators import publish as B
from storyweft.plans.registry import query
from storyweft.plans.series import _R, long_scores
from storyweft.sources.tables import AS_OF, Tables

_LIMITS = {"overall": 6.0, "linguistic": 7.0, "logical": 7.0, "rhetorical": 7.0, "emotional": 7.0}
_EXCEEDED = "x AS (SELECT narrative_id, day, list_sort(list(DISTINCT dimension) FILTER (WHERE score >= CASE WHEN dimension = 'overall' THEN 6 ELSE 7 END)) AS d FROM scores GROUP BY 1, 2), alerts AS (SELECT narrative_id, day, COALESCE(len(d), 0) AS exceeded, d, CASE WHEN narrative_id % 10 = 0 THEN 'critical' WHEN len(d) >= 3 THEN 'high' WHEN len(d) = 2 THEN 'medium' WHEN len(d) = 1 THEN 'low' ELSE 'none' END AS priority FROM x)"


def _alerts(t: Tables):
    rows = L.exceeded(long_scores(t), _LIMITS)
    return rows.withColumn("priority", L.priority(F.col("exceeded"), F.col("narrative_id") % 10 == 0))


@query("l1_high_complexity", f"SELECT narrative_id, day, dimension, score FROM scores WHERE date_diff('day', day, DATE '{AS_OF}') BETWEEN 0 AND 14 AND score >= CASE WHEN dimension = 'overall' THEN 7.5 ELSE 8 END", dates="day")
def _(t: Tables):
    return L.high_complexity(long_scores(t), AS_OF, 14)


@query("l4_alert_priority", f"WITH {_EXCEEDED} SELECT narrative_id, day, CAST(exceeded AS INT) AS exceeded, priority FROM alerts", dates="day")
def _(t: Tables):
    return _alerts(t).select("narrative_id", "day", "exceeded", "priority")


@query("l5_alert_message", f"WITH {_EXCEEDED} SELECT narrative_id, day, 'Narrative ' || narrative_id || ' exceeds its limits in: ' || array_to_string(d, ', ') AS message, CASE priority WHEN 'critical' THEN 'email,sms,dashboard' WHEN 'high' THEN 'email,dashboard' ELSE 'dashboard' END AS channels FROM alerts WHERE exceeded > 0", dates="day")
def _(t: Tables):
    return _alerts(t).filter("exceeded > 0").select("narrative_id", "day", L.message(F.col("narrative_id"), F.col("dimensions")).alias("message"), L.channels(F.col("priority")).alias("channels"))


@query("l6_newest_critical", f"""WITH {_EXCEEDED} SELECT narrative_id AS id, day AS "at" FROM alerts WHERE priority = 'critical' AND exceeded > 0 ORDER BY "at" DESC, id LIMIT 20""", dates="at")
def _(t: Tables):
    return L.newest(_alerts(t).filter("priority = 'critical' AND exceeded > 0").select(F.col("narrative_id").alias("id"), F.col("day").alias("at")), 20)


@query("a21_alerts_by_priority", f"WITH {_EXCEEDED}, p(priority) AS (VALUES ('critical'), ('high'), ('medium'), ('low')) SELECT p.priority, COUNT(a.day) AS n FROM p LEFT JOIN alerts a USING (priority) GROUP BY 1")
def _(t: Tables):
    return L.by_priority(_alerts(t))


@query("l8_notifications", f"""WITH {_EXCEEDED}, c AS (SELECT narrative_id AS id, day AS "at", unnest(CASE priority WHEN 'critical' THEN ['email', 'sms', 'dashboard'] WHEN 'high' THEN ['email', 'dashboard'] ELSE ['dashboard'] END) AS channel FROM alerts WHERE exceeded > 0) SELECT id, "at", channel FROM c""", dates="at")
def _(t: Tables):
    rows = _alerts(t).filter("exceeded > 0").select(F.col("narrative_id").alias("id"), F.col("day").alias("at"), L.channels(F.col("priority")).alias("channels"))
    return L.notifications(rows)


@query("o5_merged_alerts", """WITH a AS (SELECT instance_id AS id, detected_at AS "at", platform AS kind FROM instances), k AS (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY "at" DESC, id) <= 5) SELECT id, "at", kind FROM k ORDER BY "at" DESC, id LIMIT 20""", dates="at")
def _(t: Tables):
    return L.newest(t.instances.select(F.col("instance_id").alias("id"), F.col("detected_at").alias("at"), F.col("platform").alias("kind")), 20, "kind", 5)


@query("o1_newest", "SELECT narrative_id, last_updated FROM narratives ORDER BY last_updated DESC, narrative_id LIMIT 25", dates="last_updated")
def _(t: Tables):
    return t.narratives.select("narrative_id", "last_updated").orderBy(F.desc("last_updated"), "narrative_id").limit(25)


@query("o2_paging", "SELECT narrative_id FROM narratives ORDER BY last_updated DESC, narrative_id LIMIT 25 OFFSET 50")
def _(t: Tables):
    return t.narratives.select("narrative_id", "last_updated").orderBy(F.desc("last_updated"), "narrative_id").offset(50).limit(25).select("narrative_id")


@query("o6_newest_labelled", "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND toxic = 1 ORDER BY doc_id DESC LIMIT 20")
def _(t: Tables):
    return t.raw("documents").select("doc_id", "lang").filter("lang = 'en'").join(t.raw("labels").filter("toxic = 1"), "doc_id", "left_semi").orderBy(F.desc("doc_id")).limit(20)


@query("p14_analysis_due", "WITH t AS (SELECT narrative_id, last_updated FROM narratives WHERE status = 'active' AND threat_level >= 3 ORDER BY last_updated DESC, narrative_id LIMIT 5) SELECT narrative_id FROM t WHERE narrative_id % 3 <> 0")
def _(t: Tables):
    top = t.narratives.filter("status = 'active' AND threat_level >= 3").orderBy(F.desc("last_updated"), "narrative_id").limit(5)
    return top.filter("narrative_id % 3 <> 0").select("narrative_id")


@query("p17_validate_event", "SELECT instance_id, CASE WHEN value < 0 OR value > 500 THEN 'confidence' WHEN narrative_id NOT IN (SELECT narrative_id FROM narratives WHERE status <> 'archived') THEN 'narrative' ELSE 'ok' END AS verdict FROM instances")
def _(t: Tables):
    known = t.narratives.filter("status <> 'archived'").select("narrative_id", F.lit(True).alias("known"))
    verdict = F.when((F.col("value") < 0) | (F.col("value") > 500), "confidence").when(F.col("known").isNull(), "narrative").otherwise("ok")
    return t.instances.join(known, "narrative_id", "left").select("instance_id", verdict.alias("verdict"))


@query("e2_intersect", "SELECT source_id FROM instances WHERE narrative_id = 1 INTERSECT SELECT source_id FROM instances WHERE narrative_id = 2")
def _(t: Tables):
    of = lambda n: t.instances.filter(F.col("narrative_id") == n).select("source_id")
    return of(1).intersect(of(2))


@query("e3_difference", "SELECT source_id FROM instances WHERE narrative_id = 1 EXCEPT SELECT source_id FROM instances WHERE narrative_id = 2")
def _(t: Tables):
    of = lambda n: t.instances.filter(F.col("narrative_id") == n).select("source_id").distinct()
    return of(1).exceptAll(of(2))


@query("e1_union_of_kinds", "SELECT platform AS kind, COUNT(*) AS n FROM instances WHERE platform IN ('error', 'view') GROUP BY 1")
def _(t: Tables):
    kinds = t.instances.filter("platform = 'error'").unionByName(t.instances.filter("platform = 'view'"))
    return kinds.groupBy(F.col("platform").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("s16_last_ingestion", "SELECT source_id, MAX(detected_at) AS last_ingestion FROM instances GROUP BY 1", dates="last_ingestion")
def _(t: Tables):
    return t.instances.groupBy("source_id").agg(F.max("detected_at").alias("last_ingestion"))


@query("s15_add_sources_if_absent", "SELECT 'New ' || r_name AS name FROM region WHERE 'New ' || r_name NOT IN (SELECT name FROM sources)")
def _(t: Tables):
    return t.raw("region").select(F.concat(F.lit("New "), "r_name").alias("name")).join(t.sources.select("name"), "name", "left_anti")


@query("s19_s20_evidence", "SELECT instance_id, sha256(format('{{\"instance_id\":\"{}\",\"narrative_id\":\"{}\",\"platform\":\"{}\"}}', instance_id, narrative_id, platform)) AS evidence_hash, TRUE AS valid FROM instances")
def _(t: Tables):
    rows = B.evidence(t.instances, ["platform", "narrative_id", "instance_id"])
    return B.verify_evidence(rows).select("instance_id", "evidence_hash", "valid")


@query("s21_pending_evidence", "SELECT COUNT(*) FILTER (WHERE instance_id % 4 = 0) AS pending, COUNT(*) AS total FROM instances")
def _(t: Tables):
    return B.pending_evidence(t.instances.withColumn("evidence_hash", F.when(F.col("instance_id") % 4 != 0, "x")))


@query("s18_long_report", "SELECT narrative_id, 'overview' AS section, 'status' AS field, status AS value FROM narratives UNION ALL SELECT narrative_id, 'overview', 'language', language FROM narratives UNION ALL SELECT narrative_id, 'overview', 'threat_level', CAST(threat_level AS VARCHAR) FROM narratives")
def _(t: Tables):
    return B.long_report(t.narratives, ["status", "language", "threat_level"])


@query("s22_export_graph", """SELECT '{"kind":"node","id":' || source_id || '}' AS json FROM sources UNION ALL SELECT DISTINCT '{"kind":"edge","source":' || source_id || ',"target":' || narrative_id || '}' FROM shares""")
def _(t: Tables):
    edges = t.shares.select(F.col("source_id").alias("a"), F.col("narrative_id").alias("b")).distinct()
    return B.node_link(t.sources.select(F.col("source_id").alias("node")), edges)


@query("s23_publication_bundle", """WITH p AS (SELECT narrative_id, instance_id FROM instances QUALIFY ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY instance_id) <= 5), g AS (SELECT narrative_id, string_agg(CAST(instance_id AS VARCHAR), ',' ORDER BY instance_id) AS i FROM p GROUP BY 1) SELECT n.narrative_id, '{"instances":[' || COALESCE(i, '') || '],"narrative_id":' || n.narrative_id || ',"status":"' || status || '"}' AS document FROM narratives n LEFT JOIN g ON g.narrative_id = n.narrative_id""")
def _(t: Tables):
    parts = t.instances.select("narrative_id", F.col("instance_id").alias("part_id"))
    return B.bundle(t.narratives.select("narrative_id", "status"), parts, "narrative_id", "instances", 5)


@query("s24_source_bundle", """WITH p AS (SELECT source_id, instance_id FROM misinfo_events QUALIFY ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY instance_id) <= 3), g AS (SELECT source_id, string_agg(CAST(instance_id AS VARCHAR), ',' ORDER BY instance_id) AS i FROM p GROUP BY 1) SELECT s.source_id, '{"events":[' || COALESCE(i, '') || '],"name":"' || name || '","source_id":' || s.source_id || '}' AS document FROM sources s LEFT JOIN g ON g.source_id = s.source_id""")
def _(t: Tables):
    return B.bundle(t.sources.select("source_id", "name"), t.misinfo_events.select("source_id", F.col("instance_id").alias("part_id")), "source_id", "events", 3)


@query("s25_content_catalog", "SELECT narrative_id AS content_id, arg_max(md5(CAST(instance_id AS VARCHAR)), (detected_at, instance_id)) AS hash FROM instances GROUP BY 1")
def _(t: Tables):
    rows = t.instances.select(F.col("narrative_id").alias("content_id"), F.md5(F.col("instance_id").cast("string")).alias("hash"), F.struct("detected_at", "instance_id").alias("at"))
    return B.content_catalog(rows).drop("at")


@query("s27_candidate_feeds", "SELECT DISTINCT url, regexp_extract(url, '^(https?://[^/]+)', 1) || p AS candidate FROM pages, (SELECT unnest(['/feed', '/rss', '/rss.xml', '/atom.xml', '/feed.xml', '/index.xml']) AS p)")
def _(t: Tables):
    return B.candidate_feed_urls(t.raw("pages").select("url"))


@query("s28_status_changes", "WITH c AS (SELECT doc_id % 200 AS id, arg_max(CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'rejected' END, doc_id) AS new_status FROM documents GROUP BY 1), r AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'draft' ELSE 'published' END AS status FROM documents) SELECT r.id, CASE WHEN new_status IS NOT NULL AND (new_status <> 'approved' OR status = 'draft') THEN new_status ELSE status END AS status FROM r LEFT JOIN c USING (id)")
def _(t: Tables):
    n = F.col("doc_id")
    rows = t.raw("documents").select(n.alias("id"), F.when(n % 2 == 0, "draft").otherwise("published").alias("status"))
    changes = t.raw("documents").select((n % 200).alias("id"), F.when(n % 3 == 0, "approved").otherwise("rejected").alias("new_status"), n.alias("at"))
    return B.apply_status_changes(rows, changes)


@query("s29_edit_feed_list", """SELECT source_id, format('{{"feeds":["https://feeds.example.org/{}/atom","https://new.example.org/rss"],"category":"c{}"}}', source_id, source_id % 5) AS config FROM sources WHERE source_id = 7 UNION ALL SELECT source_id, format('{{"feeds":["https://feeds.example.org/{}/rss","https://feeds.example.org/{}/atom","https://new.example.org/rss"],"category":"c{}"}}', source_id, source_id, source_id % 5) FROM sources WHERE source_id <> 7""")
def _(t: Tables):
    return B.edit_feed_list(t.sources, ["https://new.example.org/rss"], ["https://feeds.example.org/7/rss"])


@query("s17_trends_report", "WITH w AS (SELECT narrative_id, ROUND(AVG(score) FILTER (WHERE dimension = 'overall'), 6) AS overall FROM scores GROUP BY 1) SELECT n.narrative_id, status, last_updated, COALESCE(overall, 0.0) AS overall FROM narratives n JOIN w USING (narrative_id)", dates="last_updated")
def _(t: Tables):
    from storyweft.operators.aggregates import compare_dimensions

    return _R(B.trends_report(t.narratives, compare_dimensions(long_scores(t), ["overall"]), ["overall"]), "overall")
