"""Cases of the third round's findings."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyweft.functions.numbers import rounded
from storyweft.operators import birch as B
from storyweft.operators import clusters as C
from storyweft.operators import density as D
from storyweft.operators import forecast as P
from storyweft.operators import graph as G
from storyweft.operators import joins as J
from storyweft.operators import linking as L
from storyweft.operators import text as T
from storyweft.operators import vectors as V


def test_co_sharing_in_chunks(spark):
    """Lists of a few sources face one another without losing or repeating a pair, and pairs are never joined by narrative and item."""
    shares = [(s, n) for n in range(6) for s in range(3 * n + 1)]
    rows = spark.createDataFrame(shares, "source_id long, narrative_id long")
    want = {(a, b): sum(a <= 3 * n and b <= 3 * n for n in range(6)) for a, b in combinations(range(16), 2)}
    for chunk in (4, 512):
        got = J.co_sharing(rows.unionByName(rows), chunk=chunk)
        assert {(r.a, r.b): r.weight for r in got.collect()} == want
    directed = {(r.a, r.b): r.share for r in J.directed_shares(rows).collect()}
    assert directed[0, 15] == 1 / 6 and directed[15, 0] == 1.0


def test_usual_edges_are_stored(spark):
    """What the graph operators read many times is computed once."""
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 3, 9), (3, 4, 1)], "a long, b long, weight long")
    found = J.above_usual(edges, "weight")
    assert "Scan ExistingRDD" in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in found.collect()] == [(2, 3)]


@pytest.mark.parametrize("dense", [0, 4096])
def test_betweenness_of_several_components(spark, dense):
    """Both ways agree with hand-computed values: a path, a star and a square."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (10, 13), (20, 21), (21, 22), (22, 23), (23, 20)], "a long, b long")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    got = {r.node: r.betweenness for r in G.betweenness(edges, nodes, dense=dense).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 0, 10: 3, 11: 0, 12: 0, 13: 0, 20: 0.5, 21: 0.5, 22: 0.5, 23: 0.5}


def test_descendants_at_any_depth(spark):
    """A chain of nine, a cycle, and a branch that isn't reached."""
    edges = spark.createDataFrame([(n, n + 1) for n in range(1, 9)] + [(9, 3), (20, 21)], "a long, b long")
    assert sorted(r.node for r in G.descendants(edges, spark.createDataFrame([(1,)], "node long")).collect()) == list(range(1, 10))


def test_rounding_as_sql_does(spark):
    """Doubles on either side of a half that their shortest decimal form hides."""
    import duckdb

    values = [2.0343335, -2.0343335, 0.0000005, 1.0000015, 0.3333335, 1e12 + 0.5, float("nan"), -1e-9, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x")).alias("y"))
    want = [duckdb.execute("SELECT ROUND(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [repr(r.y) for r in rows.collect()] == [repr(w + 0.0) for w in want]


def test_ranks_ignore_the_noise_of_sums(spark):
    rows = spark.createDataFrame([(1, "overall", 0.1 + 0.2), (2, "overall", -0.3), (3, "overall", 0.3000000000000001)], "narrative_id long, dimension string, slope double")
    assert [r.narrative_id for r in P.rank_trends(rows.orderBy(F.desc("narrative_id")), 2).collect()] == [1, 2]


@pytest.mark.parametrize("block", [3, 16_384])
def test_similar_links_are_counted_without_pairs(spark, block):
    """Counts and components of all links, by brute force, in one block and in many; links of settled rows to larger ids are left out."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(12, 3))) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i * 7, "abc"[j], float(x[i, j]), i % 3 == 0) for i in range(12) for j in range(3)]
    weights = spark.createDataFrame(rows, "narrative_id long, word string, weight double, settled boolean")
    for settled in (False, True):
        near = [(a, b) for a, b in combinations(range(12), 2) if x[a] @ x[b] > 0.8 and not (settled and a % 3 == 0)]
        label = list(range(12))
        for _ in range(12):
            for a, b in near:
                label[a] = label[b] = min(label[a], label[b])
        got = {r.narrative_id: (r.n_links, r.component) for r in T.similar_links(weights if settled else weights.drop("settled"), 0.8, block).collect()}
        assert got == {7 * i: (sum(i in p for p in near), 7 * label[i]) for i in range(12)}


def test_updated_narratives_by_the_lower_limit(spark, data):
    """Every narrative that some text matches by more than 0.15 is updated, not those of near copies only."""
    from storyweft.plans import ORACLE_SQL

    assert "similarity > 0.15" in ORACLE_SQL["x9_updated_narratives"] and "similarity > 0.85" not in ORACLE_SQL["x9_updated_narratives"]
    assert "status = 'active'" not in ORACLE_SQL["g10_belief_network"].split("tf AS")[0].split("w AS (SELECT narrative_id, unnest")[1]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_nearest_by_blocks_with_many_ties(spark, metric):
    """Blocks of queries and batches of rows find what brute force finds, copies by the smaller id, and rows themselves never."""
    rng = np.random.default_rng(5)
    base = np.concatenate([np.repeat(rng.normal(size=(3, 6)), 20, axis=0), rng.normal(size=(40, 6))])
    ids = rng.permutation(1000)[:100]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, base, strict=True)], "id long, vector array<double>")
    got = {}
    for r in V.knn(rows.filter("id % 3 = 0").select(F.col("id").alias("query_id"), "vector"), rows, 4, metric, block=9).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    for i, v in zip(ids, base, strict=True):
        if i % 3 == 0:
            d = {"cosine": 1 - base @ v / (np.linalg.norm(base, axis=1) * np.linalg.norm(v)), "l2": np.sqrt(((base - v) ** 2).sum(1)), "ip": -(base * v).sum(1)}[metric]
            want = sorted((round(x, 9), int(j)) for x, j in zip(d, ids, strict=True) if j != i)[:4]
            assert [got[i][k + 1] for k in range(4)] == [j for _, j in want]


def test_candidates_are_never_rows(spark):
    """Signature search compares candidates where blocks meet: no join of probes with codes in its plan."""
    rows = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(60)], "id long, vector array<double>")
    found = V.signature_search(rows.filter("id < 5").select(F.col("id").alias("query_id"), "vector"), rows, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 15


def test_related_classes_lose_no_pair(spark):
    """Pairs of classes expanded by their members are the pairs of the plain operator."""
    rows = [(n, node, "supports" if node % 3 == 0 else None, node / 4 if node % 2 else None) for n, nodes in enumerate([(1, 2), (1, 2), (2, 3), (1, 2), (6,), (2, 3), (9,), (6, 9)]) for node in nodes]
    edges = spark.createDataFrame(rows, "narrative_id long, node long, relation string, weight double")
    found = J.related_classes(edges).collect()
    members = {}
    for r in found:
        if r.kind == "member":
            members.setdefault(r.b, []).append(r.a)
    got = {(min(a, b), max(a, b)): (r.nodes, r.relation, r.weight) for r in found if r.kind == "pair" for a in members[r.a] for b in members[r.b] if a != b}
    assert got == {(r.a, r.b): (r.nodes, r.relation, r.weight) for r in J.related_by_nodes(edges).collect()}
    assert len(found) < len(got) + 8


def test_profiles_link_across_cells(spark):
    """Groups are brute force's, also where cells are joined by members other than their leaders, and copies make no more pairs."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.uniform(0, 4, size=(60, 5)), np.repeat([[9.0, 9, 9, 9, 9]], 5, axis=0), [[20.0, 0, 0, 0, 0], [20.9, 0, 0, 0, 0], [20.45, 0, 0, 0, 0], [21.4, 0, 0, 0, 0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "narrative_id long, p array<double>")
    label = list(range(len(x)))
    near = [(a, b) for a, b in combinations(range(len(x)), 2) if round(float(np.linalg.norm(x[a] - x[b])), 9) <= 1.0]
    for _ in x:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {i: (c, label.count(c)) for i, c in enumerate(label) if label.count(c) >= 3}
    got = {r.narrative_id: (r.cluster, r.size) for r in C.coordinated_profiles(rows, 1.0).collect()}
    assert got == want and len({c for c, _ in want.values()}) >= 2


def test_change_points_at_exactly_the_limit(spark):
    """Scores that are exactly the limit count or not as in SQL, whose variances are summed in the order of days."""
    import duckdb

    from storyweft.operators import series as S
    from storyweft.plans.series import _KEPT, _SCORES

    n = np.random.default_rng(8).poisson(2, (1500, 30))
    daily = pd.DataFrame({"narrative_id": np.repeat(np.arange(1500), 30), "day": np.tile(pd.date_range("2024-01-01", periods=30).date, 1500), "n": n.ravel()})
    db = duckdb.connect()
    db.register("daily", daily)
    series = "WITH RECURSIVE series AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY day) - 1 AS i, COUNT(*) OVER (PARTITION BY narrative_id) AS len FROM daily)"
    want = db.execute(f"{series}, {_SCORES}, {_KEPT} SELECT narrative_id, CAST(h.day AS VARCHAR)[:10] AS day FROM h JOIN g USING (narrative_id, k) WHERE g.kept").fetchall()
    got = [(r.narrative_id, str(r.day)) for r in S.change_points(spark.createDataFrame(daily), 5, 2.0).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("name", ["t2_trend_metrics", "t3_rank_trends", "t21_predict_evolution", "t21_evolution_factors", "t26_pattern_shift", "t27_insights"])
def test_single_scores_as_in_sql(spark, tmp_path, name):
    """A narrative's only score of a dimension has the slope NaN in SQL, which is above every limit."""
    import duckdb

    from storyweft.plans import ORACLE_SQL, QUERIES

    at = pd.Timestamp("2024-01-05")
    rows = [(1, "click", 0, 50.0), (2, "error", 3, 20.0), (2, "view", 0, 90.0), (2, "view", 4, 10.0), (3, "signup", 1, 95.0), (3, "purchase", 1, 5.0), (3, "view", 0, 40.0), (3, "view", 2, 42.0)]
    events = pd.DataFrame([(i, at + pd.Timedelta(days=d), u, kind, v, '{"k": 1}') for i, (u, kind, d, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want, got = db.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, str(tmp_path)).toPandas()
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(lambda v: v.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want) and len(want)


def test_tasks_that_count_pairs_grow_with_them(spark, monkeypatch):
    """A task counts a bounded number of pairs, and results don't depend on how many tasks there are."""
    rows = spark.createDataFrame([(s, n) for n in range(40) for s in range(n % 13 + 1)], "source_id long, narrative_id long")
    want = {(a, b): sum(n % 13 >= b for n in range(40)) for a, b in combinations(range(13), 2)}
    monkeypatch.setattr(J, "PAIRS_AT_ONCE", 50)
    for chunk in (4, 512):
        got = J.co_sharing(rows, chunk=chunk)
        assert got.rdd.getNumPartitions() >= sum((n % 13) * (n % 13 + 1) // 2 for n in range(40)) // 50
        assert {(r.a, r.b): r.weight for r in got.collect()} == want


@pytest.mark.parametrize("most", [0, 64_000_000])
def test_graphs_with_and_without_broadcast_labels(spark, monkeypatch, most):
    """Both ways to give edges their labels agree with hand-computed values; repeated edges and loops count once."""
    monkeypatch.setattr(G, "MAX_BROADCAST", most)
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (4, 6, 1.0), (5, 6, 1.0), (8, 9, 1.0)], "a long, b long, weight double")
    assert {r.node: r.component for r in G.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8}
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8)], "node long, label long")
    assert G.modularity(edges, labels).first()["modularity"] == pytest.approx(7 / 8 - 2 * (7 / 16) ** 2 - (2 / 16) ** 2)
    assert G.modularity(edges, G.louvain_communities(edges)).first()["modularity"] >= G.modularity(edges, G.label_communities(edges)).first()["modularity"] - 1e-9
    again = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).unionByName(spark.createDataFrame([(7, 7, 1.0)], edges.schema))
    degree = {r.node: (r.degree, r.centrality) for r in G.degree_centrality(again).collect()}
    assert degree[3] == (3, 3 / 8) and degree[7] == (1, 1 / 8) and degree[9] == (1, 1 / 8)


@pytest.mark.parametrize("block", [150, 65_536])
def test_dbscan_is_exact(spark, monkeypatch, block):
    """Clusters, borders and noise as by brute force, copies included; rows without a usable vector are noise. Hashing into buckets narrower than the radius lost links."""
    monkeypatch.setattr(V, "BLOCK", block)
    draw = np.random.default_rng(1)
    x = np.round(np.concatenate([draw.normal(size=(200, 2)), draw.normal(size=(120, 2)) + 30, np.tile([[60.0, 60.0]], (40, 1)), draw.uniform(-90, 90, (140, 2))]), 1)
    ids, eps, least = draw.permutation(len(x)), 3.0, 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = (d < eps) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) + 1 >= least
    label = {i: ids[i] for i in np.flatnonzero(core)}
    while True:
        new = {i: min([label[j] for j in np.flatnonzero(near[i] & core)] + [label[i]]) for i in label}
        if new == label:
            break
        label = new
    want = {90_001: -1, 90_002: -1}
    for i in range(len(x)):
        reached = min(((d[i, j], ids[j], j) for j in np.flatnonzero(near[i] & core)), default=None)
        want[ids[i]] = label[i] if i in label else -1 if reached is None else label[reached[2]]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(90_001, None), (90_002, [None, 1.0])], "id long, vector array<double>")
    assert {r.id: r.cluster for r in V.dbscan(rows, eps, least).collect()} == want


def test_fading_micro_clusters_with_many_outliers(spark):
    """More outliers than fit one list: a row joins the nearest core in reach, else the nearest outlier, of equally near ones the smaller; others start their own."""
    at = F.lit("2024-01-01").cast("timestamp")
    state = spark.range(10_101).select(F.col("id").alias("cluster"), F.when(F.col("id") < 100, "core").otherwise("outlier").alias("kind"), F.array((F.col("id") * 10).cast("double")).alias("vector"), F.lit(1.3).alias("weight"), at.alias("created"), at.alias("at"))
    batch = spark.createDataFrame([(1, [51.0]), (2, [5002.0]), (3, [505_000.0]), (4, [505_001.0]), (5, [5005.0])], "id long, vector array<double>").withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    out = {r.cluster: r.weight for r in D.step(state, batch, 5.0, rate=1e-6).collect()}
    grown = {c: round(w - 1.3, 3) for c, w in out.items() if c < 0 or w > 2}
    assert len(out) == 10_102 and grown == {5: 1.0, 500: 2.0, -5: 0.7}


def test_best_match_by_shared_words(spark):
    """As by sets of words; rows that repeat an id compete, texts without words, text or language match nothing, and no set is built for a pair."""
    said = {1: ("en", "a b c d"), 2: ("en", "A, b!"), 3: ("de", "a b"), 4: ("en", ""), 5: ("en", None), 6: (None, "a b"), 7: ("en", "c d e f"), 8: ("en", "x")}
    texts = spark.createDataFrame([(k, *v, k) for k, v in said.items()], "narrative_id long, language string, text string, last_updated long")
    items = spark.createDataFrame([(10, "en", "b b a"), (10, "en", "c d e f g"), (11, "en", "a c q"), (12, "de", "a"), (13, "en", "zz"), (14, None, "a b"), (15, "en", None), (16, "fr", "a")], "item_id long, language string, text string")
    found = T.best_match(items, texts, 5, 0.05)
    assert {(r.item_id, r.narrative_id, r.similarity) for r in found.collect()} == {(10, 2, 1.0), (11, 2, 0.25), (12, 3, 0.5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_union" not in plan and "array_intersect" not in plan


def test_links_of_repeated_items(spark):
    """Items that repeat an id and a text are linked once each, and named after the first item with that text, null included."""
    items = spark.createDataFrame([(1, "t", "en", 0.5, 1), (1, "t", "en", 0.5, 1), (2, "t", "en", 0.5, 1), (3, "t", "de", 0.5, 1), (4, None, None, 0.5, 1), (5, None, None, 0.5, 1), (6, "u", "en", 0.9, 3)], "item_id long, text string, language string, confidence double, at long")
    matches = spark.createDataFrame([(6, 70, 0.9)], "item_id long, narrative_id long, similarity double")
    narratives = spark.createDataFrame([(70, "old", 2, 0.1)], "narrative_id long, title string, last_updated long, confidence_score double")
    out = L.link_to_narrative(items, matches, narratives)
    assert sorted((r.item_id, r.narrative_id, r.is_new) for r in out["links"].collect()) == [(1, -2, True), (1, -2, True), (2, -2, True), (3, -4, True), (4, -5, True), (5, -5, True), (6, 70, False)]
    assert [tuple(r) for r in out["updated"].collect()] == [(70, 3, 0.9)]


def test_summaries_within_the_row(spark):
    """Sentences by the mean frequency of their words, ties to the first, in their order; no words or no text, no row; nothing is shuffled by word."""
    texts = [(1, "A b c. A a b! The x y z. B a."), (2, "One. Two. Three."), (3, "..."), (4, None), (5, ""), (6, "!!! Only words here"), (7, "Été été. Autre.")]
    rows = spark.createDataFrame(texts, "narrative_id long, text string").repartition(3)
    found = T.summarize(rows, 2)
    assert {r.narrative_id: r.summary for r in found.collect()} == {1: "A a b! B a.", 2: "One. Two.", 6: "Only words here", 7: "Été été. Autre."}
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_features_of_a_crowded_cell(spark):
    """A cell with more features than a tree holds is merged in parts: no task gathers more than some, totals stay exact, and radii within the threshold."""
    vectors = np.random.default_rng(3).normal(size=(3000, 8)) * 0.3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    features = B.clustering_features(rows, 0.05, most=200)
    out = features.toPandas()
    assert out["n"].sum() == 3000 and np.allclose(np.stack(out["ls"]).sum(0), vectors.sum(0)) and np.isclose(out["ss"].sum(), (vectors**2).sum()) and (out["radius"] <= 0.05 + 1e-6).all()
    assert "of#" in features._jdf.queryExecution().executedPlan().toString()  # the part of a cell


def test_text_clusters_read_stored_rows(spark):
    """Rows are computed once for the fit and the assignment; words that share a dimension add up."""
    weights = spark.createDataFrame([(i, w, 1.0) for i in range(20) for w in ("ab" if i % 2 else "cd")], "narrative_id long, word string, weight double")
    found = T.text_clusters(weights, 2, 16)
    by = {r.narrative_id: r.cluster for r in found.collect()}
    assert len(by) == 20 and len({by[i] for i in range(0, 20, 2)}) == 1 and by[0] != by[1]
    assert "Scan ExistingRDD" in found._jdf.queryExecution().executedPlan().toString() and "map_from_entries" not in found._jdf.queryExecution().analyzed().toString()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["t23_similar_trajectories", "t24_series_correlation", "w13_lag_correlation"])
def test_constant_series_as_in_sql(spark, tmp_path, name):
    """Series that never change, by counts or by none within the calendar, correlate with nothing; dividing by their deviation was an error."""
    import duckdb

    from storyweft.plans import ORACLE_SQL, QUERIES

    counts = {1: [1] * 30, 2: [0] * 30, 3: [d % 3 for d in range(30)], 4: [0] * 20 + [2] * 10, 5: [(d + 1) % 3 for d in range(30)], 6: [d % 3 + d % 2 for d in range(30)], 7: [3] * 30}
    days = [(n, d) for n, c in counts.items() for d, k in enumerate(c) for _ in range(k)] + [(2, 45)]
    events = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), n, "view", 1.0, '{"k": 1}') for i, (n, d) in enumerate(days)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    events.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want, got = db.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, str(tmp_path)).toPandas()
    plain = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(want) and len(want)


def test_correlation_of_noisy_constants(spark):
    """A constant's merged sums miss 0 by their noise, whatever the parts; points with a null and single points count as none."""
    pairs = spark.range(30 * 400).select((F.col("id") % 400).alias("a"), F.lit(0).alias("b"), ((F.col("id") % 400) * 0.1).alias("ya"), F.rand(1).alias("yb")).repartition(3)
    assert {r.r for r in P.series_correlation(pairs).collect()} == {0.0}
    few = spark.createDataFrame([(1, 2, 1.0, None), (1, 2, 2.0, 5.0), (3, 4, None, None), (5, 6, 1.0, 2.0), (5, 6, 2.0, 1.0), (5, 6, 9.0, None)], "a long, b long, ya double, yb double")
    assert {(r.a, r.r, r.band) for r in P.series_correlation(few).collect()} == {(1, 0.0, "none"), (3, 0.0, "none"), (5, -1.0, "strong")}


def test_trajectories_of_unlike_lengths(spark):
    """Series meet at their ends, as far as the shorter goes; a pair that is listed twice counts once, and a constant end is like nothing."""
    lists = {1: [9, 1, 2, 3], 2: [2, 4, 6], 3: [5, 5, 5, 5], 4: [7], 5: [3, None, 2, 1]}
    rows = [(k, f"2024-01-{d + 1:02}", None if n is None else float(n)) for k, v in lists.items() for d, n in enumerate(v)]
    series = spark.createDataFrame(rows, "narrative_id long, day string, n double")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (1, 5), (2, 5), (3, 4)], "a long, b long")
    got = {(r.a, r.b): r.similarity for r in P.similar_trajectories(series, pairs, 4, 5, least=-1).collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.5, (1, 4): 0.5, (1, 5): 0.896203, (2, 5): 0.0, (3, 4): 0.5}
