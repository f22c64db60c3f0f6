"""Faults found in the code before: the fourth round."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.operators import birch as B
from storyweft.operators import clusters as C
from storyweft.operators import graph as G
from storyweft.operators import joins as J
from storyweft.operators import series as S
from storyweft.operators import text as T


def test_a_point_at_the_limit_is_no_anomaly(spark):
    """Counts whose score is exactly 2.5: by running sums of doubles some lie above it, by the order of the days."""
    rng, found = np.random.default_rng(7), []
    while len(found) < 6:
        x = rng.poisson(2.2, size=(500_000, 30))
        s, q = x.sum(1, keepdims=True), (x * x).sum(1, keepdims=True)
        found += x[((4 * (30 * x - s) ** 2 == 25 * (30 * q - s * s)) & (30 * q > s * s)).any(1)].tolist()
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(30)]
    rows = spark.createDataFrame([(i, days[d], int(v)) for i, x in enumerate(found) for d, v in enumerate(x)], "narrative_id long, day date, n long")
    got = S.global_anomaly(rows, 2.5).collect()
    at = [r for r in got if abs(r.z - 2.5) < 1e-9]
    assert len(at) >= 6 and not any(r.is_anomaly for r in at)
    for r in got:
        x = np.array(found[r.narrative_id])
        assert abs(r.z - abs(r.n - x.mean()) / x.std()) < 1e-9


def test_paths_of_any_length_from_all_starts(spark):
    """Every reachable node has its path, however long, and of equals that with the smallest nodes; pairs go against the edges where they must."""
    line = [(i, i + 1) for i in range(1, 9)] + [(1, 20), (20, 3), (50, 51)]
    edges = spark.createDataFrame(line, "a long, b long")
    got = {(r.start, r.node): r.path for r in G.shortest_paths(edges, spark.createDataFrame([(1,), (50,)], "node long"), directed=False).collect()}
    assert got[1, 9] == list(range(1, 10)) and got[50, 51] == [50, 51] and len(got) == 12
    pairs = spark.createDataFrame([(9, 1), (1, 50)], "a long, b long")
    assert {(r.a, r.b): r.path for r in G.shortest_path(edges, pairs).collect()} == {(9, 1): list(range(1, 10)), (1, 50): None}


def test_one_component_of_thousands_of_nodes(spark):
    """A component of more than 4096 nodes goes by matrix products, not by a row for each source and node."""
    n = 4200
    edges = spark.createDataFrame([(i, (i + k) % n) for i in range(n) for k in (1, 7, 61)], "a long, b long")
    assert G.DENSE >= n
    rows = G.betweenness(edges, edges.select(F.col("a").alias("node")).filter("node < 300"))
    got = {r.node: r.betweenness for r in rows.collect()}
    near = [sorted({(i + k) % n for k in (1, 7, 61, -1, -7, -61)}) for i in range(n)]
    one, order, depth, paths = np.zeros(n), [0], {0: 0}, np.zeros(n)
    paths[0] = 1
    for v in order:
        for w in near[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                order.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
    for w in reversed(order):
        for v in near[w]:
            if depth[v] == depth[w] - 1:
                one[v] += paths[v] / paths[w] * (1 + one[w])
    one[0] = 0
    assert all(abs(got[v] - sum(one[(v - s) % n] for s in range(300)) / 2) < 1e-6 for v in range(0, n, 97))


def test_betweenness_of_a_long_line(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(36)], "a long, b long")
    got = {r.node: r.betweenness for r in G.betweenness(edges, edges.select(F.explode(F.array("a", "b")).alias("node"))).collect()}
    assert all(abs(got[i] - i * (36 - i)) < 1e-9 for i in range(1, 36))


def plans_of(spark, run):
    """Rows shuffled by a run: sums of the exchanges' records, from the status store of its stages."""
    before = {s.stageId() for s in stages(spark)}
    run()
    return sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before)


def stages(spark):
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_directed_pairs_are_not_shuffled_again(spark):
    """Pairs get their sources' sizes where they were counted; links and edges stay in place for every round."""
    shares = spark.createDataFrame([(s, n) for n in range(40) for s in range(n % 7, 120, 1 + n % 3)], "source_id long, narrative_id long")
    pairs = J.co_sharing(shares).count()
    assert plans_of(spark, lambda: J.directed_shares(shares).count()) < plans_of(spark, lambda: J.co_sharing(shares).count()) + pairs
    edges = spark.createDataFrame([(a, b) for a in range(150) for b in range(150) if a != b and (a + 2 * b) % 3], "a long, b long").repartition(4).checkpoint()
    assert plans_of(spark, lambda: G.strong_components(edges).count()) < edges.count()
    start = spark.createDataFrame([(0,)], "node long")
    assert plans_of(spark, lambda: G.crawl_frontier(edges, start, 120).count()) < edges.count()


@pytest.mark.parametrize("block", [3, 2048])
def test_similar_pairs_come_from_blocks(spark, block):
    """All pairs and their similarity by brute force, in one block and in many; no pair is shuffled."""
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(40, 3))) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    weights = spark.createDataFrame([(int(i) * 7, "abc"[j], float(x[i, j])) for i in rng.permutation(40) for j in range(3)], "narrative_id long, word string, weight double")
    pairs = T.similar_pairs(weights, 0.8, block)
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    want = {(7 * a, 7 * b): x[a] @ x[b] for a, b in combinations(range(40), 2) if x[a] @ x[b] > 0.8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_similar_texts_are_given_as_pairs(spark, data):
    """Links as pairs with their weight, not as a number for each text."""
    from storyweft.plans import QUERIES

    assert set(QUERIES["j9_similar_pairs"](spark, data).columns) == {"a", "b", "similarity"}
    assert set(QUERIES["g10_belief_network"](spark, data).columns) == {"a", "b", "relation", "weight"}


@pytest.mark.parametrize("chunk", [2, 512])
def test_related_narratives_are_given_as_pairs(spark, data, chunk):
    """Every two narratives that share a node are a row, those with equal edges too, in lists of any length."""
    from storyweft.plans import QUERIES

    sets = [(1, 2), (1, 2), (2, 3), (1, 2), (6,), (2, 3), (9,), (6, 9), (1, 2), (1, 2)]
    rows = [(n, node, "supports" if node % 3 == 0 else None, node / 4 if node % 2 else None) for n, nodes in enumerate(sets) for node in nodes]
    edges = spark.createDataFrame(rows, "narrative_id long, node long, relation string, weight double")
    got = sorted(tuple(r) for r in J.related_pairs(edges, chunk).collect())
    assert got == sorted(tuple(r) for r in J.related_by_nodes(edges).collect()) and len(got) == sum(bool(set(x) & set(y)) for x, y in combinations(sets, 2))
    assert set(QUERIES["j13_related_by_nodes"](spark, data).columns) == {"a", "b", "nodes", "relation", "weight"}


def test_features_of_odd_vectors(spark):
    """Vectors that are no points take no part; vectors that are all alike are one cluster."""
    rng = np.random.default_rng(2)
    sound = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    odd = [(100, [float("nan")] * 4), (101, [float("inf"), 0.0, 0.0, 0.0]), (102, [None, 0.0, 0.0, 0.0]), (103, None)]
    rows = spark.createDataFrame(sound + odd, "id long, vector array<float>")
    got = B.birch(rows, B.clustering_features(rows, 0.9), 3).collect()
    assert sorted(r.id for r in got) == list(range(40)) and len({r.cluster for r in got}) == 3
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, vector array<float>")
    assert [tuple(r) for r in B.birch(alike, B.clustering_features(alike, 0.9), 3).orderBy("id").collect()] == [(i, 0) for i in range(30)]


def test_profiles_are_never_paired_in_rows(spark):
    """Profiles that all lie near one another shuffle a few rows each, not one for each pair; a distance of the radius is a link."""
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 3, size=(1400, 5)).tolist() + [[9.0] * 5, [10.0] + [9.0] * 4, [11.0] + [9.0] * 4]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "narrative_id long, p array<double>").checkpoint()
    out = []
    assert plans_of(spark, lambda: out.extend(C.coordinated_profiles(rows, 1.0).collect())) < 60 * len(p)
    assert {r.narrative_id for r in out if r.cluster == 1400} == {1400, 1401, 1402}
