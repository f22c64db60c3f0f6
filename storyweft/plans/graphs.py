"""Queries of the graph operators, on the graph of sources that share narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.operators import graph as G
from storyweft.operators import joins as J
from storyweft.plans.joins import _CO
from storyweft.plans.registry import query
from storyweft.plans.series import _R
from storyweft.sources.tables import Tables


def _edges(t: Tables):
    """Source pairs that share far more narratives than is usual."""
    return J.above_usual(J.co_sharing(t.shares), "weight")


_E = f"{_CO}, edges AS (SELECT a, b, weight FROM co WHERE weight > (SELECT ROUND(AVG(weight) + 1.5 * STDDEV_POP(weight), 6) FROM co)), near AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"
_SPARSE = _E
_COMPONENTS = "walk AS (SELECT DISTINCT a AS node, a AS other FROM near UNION SELECT w.node, n.b FROM walk w JOIN near n ON n.a = w.other), comp AS (SELECT node, MIN(other) AS component FROM walk GROUP BY 1)"
#: The node that searches start from: the smallest of the graph.
_START = "(SELECT MIN(a) FROM near)"


def _start(edges):
    return edges.agg(F.min(F.least("a", "b")).alias("node")).filter("node is not null")


@query("g1_degree_centrality", f"WITH {_E}, d AS (SELECT a AS node, COUNT(*) AS degree FROM near GROUP BY 1) SELECT node, degree, ROUND(degree / ((SELECT COUNT(*) FROM d) - 1), 6) AS centrality FROM d")
def _(t: Tables):
    return _R(G.degree_centrality(_edges(t)), "centrality")


@query("g1_graph_statistics", f"WITH {_E}, n AS (SELECT COUNT(DISTINCT a) AS nodes FROM near) SELECT nodes, (SELECT COUNT(*) FROM edges) AS edges, ROUND((SELECT COUNT(*) FROM edges) / (nodes * (nodes - 1)), 6) AS density FROM n")
def _(t: Tables):
    return _R(G.graph_statistics(_edges(t)), "density")


@query("g2_propagation_graph", "WITH f AS (SELECT narrative_id, source_id, epoch_us(MIN(detected_at)) / 1e6 AS at FROM instances GROUP BY 1, 2) SELECT narrative_id, source_id AS a, narrative_id AS b, COUNT(*) AS weight, 'posts' AS kind FROM instances GROUP BY 1, 2 UNION ALL SELECT x.narrative_id, x.source_id, y.source_id, 1, 'follows' FROM f x JOIN f y ON y.narrative_id = x.narrative_id AND (x.at < y.at OR (x.at = y.at AND x.source_id < y.source_id)) AND y.at - x.at < 10800")
def _(t: Tables):
    return G.propagation_graph(t.instances, 3)


@query("g3_khop", f"WITH {_SPARSE}, h AS (SELECT node, 0 AS distance FROM (SELECT {_START} AS node) WHERE node IS NOT NULL UNION SELECT n.b, h.distance + 1 FROM h JOIN near n ON n.a = h.node WHERE h.distance < 2) SELECT node, CAST(MIN(distance) AS INT) AS distance FROM h GROUP BY 1")
def _(t: Tables):
    edges = _edges(t)
    return G.khop(edges, _start(edges), 2)


@query("g4_connected_components", f"WITH {_SPARSE}, {_COMPONENTS} SELECT node, component FROM comp")
def _(t: Tables):
    return G.connected_components(_edges(t))


#: A directed graph with cycles: from a source to those that share far more of its narratives than is usual.
_DIRECTED = f"{_CO}, n AS (SELECT source_id, COUNT(*) AS n FROM own GROUP BY 1), ties AS (SELECT a, b, weight / n AS share FROM (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co) JOIN n ON source_id = a), directed AS (SELECT a, b FROM ties WHERE share > (SELECT ROUND(AVG(share) + 1.5 * STDDEV_POP(share), 6) FROM ties))"


def _directed(t: Tables):
    return J.above_usual(J.directed_shares(t.shares), "share").select("a", "b")


@query("g5_strong_components", f"WITH {_DIRECTED}, nodes AS (SELECT a AS n FROM directed UNION SELECT b FROM directed), walk AS (SELECT n AS s, n AS v FROM nodes UNION SELECT w.s, d.b FROM walk w JOIN directed d ON d.a = w.v) SELECT x.s AS node, MAX(x.v) AS component FROM walk x JOIN walk y ON y.s = x.v AND y.v = x.s GROUP BY 1")
def _(t: Tables):
    return G.strong_components(_directed(t))


@query("g6_shortest_path", f"WITH {_SPARSE}, p(s, node, path) USING KEY (s, node) AS (SELECT DISTINCT a, a, [a] FROM near WHERE a % 20 = 0 UNION SELECT p.s, n.b, MIN(list_append(p.path, n.b)) FROM p JOIN near n ON n.a = p.node LEFT JOIN recurring.p r ON r.s = p.s AND r.node = n.b WHERE r.node IS NULL GROUP BY 1, 2) SELECT s AS start, node, array_to_string(path, '>') AS path FROM p")
def _(t: Tables):
    """From every source whose id 20 divides to all that it reaches, at any depth."""
    edges = _edges(t)
    starts = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node % 20 = 0").distinct()
    return G.shortest_paths(edges, starts, directed=False).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("g7_betweenness")
def _(t: Tables):
    edges = _edges(t)
    return _R(G.betweenness(edges, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "betweenness")


@query("g8_eigenvector_centrality")
def _(t: Tables):
    return _R(G.eigenvector_centrality(_edges(t), 20), "score")


@query("g9_optimize_sources")
def _(t: Tables):
    return _R(G.optimize_sources(_edges(t), t.sources.select(F.col("source_id").alias("node"), "name"), 5), "rank_score")


@query("g11_communities", f"WITH {_SPARSE}, {_COMPONENTS}, s AS (SELECT component, COUNT(*) AS size FROM comp GROUP BY 1) SELECT node, component, size FROM comp JOIN s USING (component) WHERE size >= 3")
def _(t: Tables):
    return G.communities(_edges(t), 3)


@query("g12_communities_by_type", "SELECT source_type AS type, COUNT(*) OVER (PARTITION BY source_type) AS size, source_id AS node FROM sources")
def _(t: Tables):
    return G.communities_by_type(t.sources.select(F.col("source_id").alias("node"), F.col("source_type").alias("type")))


@query("g13_label_communities")
def _(t: Tables):
    return G.label_communities(_edges(t))


@query("g13_louvain_communities")
def _(t: Tables):
    return G.louvain_communities(_edges(t))


@query("g13_modularity_gain", "SELECT TRUE AS not_below_propagation")
def _(t: Tables):
    edges = _edges(t)
    before, after = G.modularity(edges, G.label_communities(edges)), G.modularity(edges, G.louvain_communities(edges))
    return before.select(F.col("modularity").alias("m")).join(F.broadcast(after)).select((F.col("modularity") >= F.col("m") - 1e-9).alias("not_below_propagation"))  # one row each


@query("g15_central_narratives")
def _(t: Tables):
    return _R(G.central_nodes(_edges(t), 5), "score")


@query("g14_coordinated_campaigns", f"WITH {_SPARSE}, {_COMPONENTS}, d AS (SELECT source_id AS node, MIN(detected_at) AS first_at, MAX(detected_at) AS last_at FROM shares GROUP BY 1), l AS (SELECT component, COUNT(*) AS links FROM edges JOIN comp ON comp.node = edges.a GROUP BY 1), f AS (SELECT component, COUNT(*) AS size, MIN(first_at) AS first_at, date_diff('day', MIN(first_at), MAX(last_at)) AS span_days FROM comp LEFT JOIN d USING (node) GROUP BY 1 HAVING COUNT(*) >= 2) SELECT component, size, first_at, CAST(span_days AS INT) AS span_days, ROUND(2 * links / (size * (size - 1)), 6) AS density FROM f JOIN l USING (component)", dates="first_at")
def _(t: Tables):
    dates = t.shares.groupBy(F.col("source_id").alias("node")).agg(F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"))
    return _R(G.coordinated_campaigns(_edges(t), dates, 2, 2), "density")


@query("g15_network_statistics", f"WITH {_SPARSE}, {_COMPONENTS} SELECT (SELECT COUNT(*) FROM comp) AS nodes, (SELECT COUNT(*) FROM edges) AS edges, (SELECT COUNT(DISTINCT component) FROM comp) AS components, (SELECT MAX(c) FROM (SELECT COUNT(*) AS c FROM comp GROUP BY component)) AS largest")
def _(t: Tables):
    edges = _edges(t)
    labels = G.connected_components(edges)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("components"), F.max("c").alias("largest"))
    return G.graph_statistics(edges).drop("density").join(F.broadcast(sizes))


@query("g16_coordinated_sources", f"WITH {_CO}, n AS (SELECT source_id, COUNT(DISTINCT narrative_id) AS narratives FROM own GROUP BY 1), p AS (SELECT a AS source_id, COUNT(*) AS partners, SUM(weight) AS weight FROM (SELECT a, weight FROM co UNION ALL SELECT b, weight FROM co) GROUP BY 1) SELECT source_id, source_type, narratives, COALESCE(partners, 0) AS partners, CAST(COALESCE(weight, 0) AS BIGINT) AS weight FROM n JOIN sources USING (source_id) LEFT JOIN p USING (source_id)")
def _(t: Tables):
    own = t.shares
    counts = own.groupBy("source_id").agg(F.count_distinct("narrative_id").alias("narratives"))
    pairs = J.co_sharing(own)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("source_id"), "weight").groupBy("source_id").agg(F.count(F.lit(1)).alias("partners"), F.sum("weight").alias("weight"))
    zero = F.lit(0).cast("long")
    return counts.join(t.sources.select("source_id", "source_type"), "source_id").join(ends, "source_id", "left").withColumn("partners", F.coalesce("partners", zero)).withColumn("weight", F.coalesce("weight", zero))


@query("g17_narrative_connections", "WITH e AS (SELECT DISTINCT narrative_id, source_id AS node FROM shares) SELECT y.narrative_id AS other, COUNT(*) AS nodes FROM e x JOIN e y ON y.node = x.node AND y.narrative_id > x.narrative_id WHERE x.narrative_id = 1 GROUP BY 1")
def _(t: Tables):
    edges = t.shares.select("narrative_id", F.col("source_id").alias("node")).distinct()
    center = edges.filter("narrative_id = 1").select("node")
    return edges.join(center, "node").filter("narrative_id > 1").groupBy(F.col("narrative_id").alias("other")).agg(F.count(F.lit(1)).alias("nodes"))


@query("s11_crawl_frontier", f"WITH {_DIRECTED}, l AS (SELECT 'p' || a AS a, 'p' || b AS b FROM directed), w AS (SELECT node, 0 AS depth FROM (SELECT 'p' || MIN(a) AS node FROM directed) WHERE node IS NOT NULL UNION SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.node WHERE w.depth < 12 AND NOT regexp_matches(l.b, '7$')) SELECT node, CAST(MIN(depth) AS INT) AS depth FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 30")
def _(t: Tables):
    own = _directed(t)
    links = own.select(F.concat(F.lit("p"), "a").alias("a"), F.concat(F.lit("p"), "b").alias("b"))
    start = own.agg(F.concat(F.lit("p"), F.min("a")).alias("node")).filter("node is not null")
    return G.crawl_frontier(links, start, 30, "7$")
