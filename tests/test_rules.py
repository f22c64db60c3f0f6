"""Expected values worked out from the rules by hand, for texts, feeds, outlines, linking, series, clusters and graphs."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as X
from storyweft.operators import birch as B
from storyweft.operators import clusters as C
from storyweft.operators import density as D
from storyweft.operators import forecast as P
from storyweft.operators import graph as G
from storyweft.operators import ingest as I
from storyweft.operators import linking as L
from storyweft.operators import publish as U
from storyweft.operators import vectors as V


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").orderBy("i")


def series(spark, values, key=1):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(key, day + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "narrative_id long, day date, n double")


def test_cleaning_deletes_marks_without_a_space(spark):
    df = texts(spark, "Don't  STOP, it's www.site.org/x fine", "a<b>c</b>d https://x.y/z\te", None, "<a\nb> (x)", "the cat!")
    got = [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()]
    assert got == ["dont stop its fine", "acd e", "", "a b x", "the cat"]
    assert texts(spark, "the cat and a dog").select(X.clean_text(F.col("t"), ["the", "and"])).first()[0] == "cat a dog"


def test_language_markers_are_whole_cleaned_words(spark):
    df = texts(spark, "it's that's for the and", "it is that for", "The. And, is! in?", None)
    assert [r[0] for r in df.select(X.detect_language(F.col("t"))).collect()] == ["unknown", "en", "en", "unknown"]


def test_iso_times(spark):
    good = {
        "2024-01-01": "2024-01-01 00:00:00", "2024-01-01T00:00:00Z": "2024-01-01 00:00:00", "2024-01-01 10:20": "2024-01-01 10:20:00", "20240102T0304": "2024-01-02 03:04:00",
        "2024-01-01T10": "2024-01-01 10:00:00", "2024-01-01T23:30:00-02:00": "2024-01-02 01:30:00", "2024-01-01T01:02:03.123456": "2024-01-01 01:02:03", "2024-W01-1": "2024-01-01 00:00:00",
        "2020-W53-5T12:00": "2021-01-01 12:00:00", "2024-01-01T12:00+0530": "2024-01-01 06:30:00", "20240101": "2024-01-01 00:00:00",
    }
    bad = ["2024", "2024-01", "01/02/2024", "2024-13-01", "2024-01-01T25:00", "soon", "", "2024-1-1", None]
    df = texts(spark, *good, *bad)
    got = [r[0] for r in df.select(F.date_format(X.iso_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [*good.values(), *[None] * len(bad)]


def test_feed_links_contents_and_defaults(spark):
    atom = '<feed><entry><link rel="alternate" type="text/html" href="p1"/><link rel="edit" href="e"/><link rel="alternate" type="application/json" href="j"/><content type="html">one</content><content>two</content></entry><entry><title>T</title><link rel="self" href="s"/><summary>sum</summary></entry></feed>'
    rss = '<rss xmlns:content="http://c"><channel><item><title>R</title><description>d</description><content:encoded>full</content:encoded></item><item><description>only</description></item></channel></rss>'
    rows = I.parse_feed_items(spark.createDataFrame([(1, atom), (2, rss), (3, "no feed")], "feed_id long, xml string"), 5).orderBy("feed_id", "place").collect()
    assert [(r["feed_title"], r["title"], r["content"], r["link"], r["published"], r["author"]) for r in rows] == [
        ("Unknown Feed", "No Title", "one two", "p1", "", ""), ("Unknown Feed", "T", "sum", "", "", ""), ("Unknown Feed", "R", "full", "", "", ""), ("Unknown Feed", "No Title", "only", "", "", ""),
    ]


def test_outlines_of_any_quotes_and_depth(spark):
    good = "<?xml version='1.0'?><!DOCTYPE opml><opml><body><outline text='a > b'><outline type='rss' xmlUrl='u1' title='One &amp; all'/><outline type=\"rss\" xmlUrl=\"u2\" text=\"it's\"/></outline><!-- <outline type='rss' xmlUrl='no'/> --><outline type='rss' xmlUrl='u3'/><outline type='rss' title='no address'/><outline type='link' xmlUrl='u4'/></body></opml>"
    rows = I.import_opml(spark.createDataFrame([(1, good), (2, "<opml><body><outline"), (3, "text"), (4, None)], "outline_id long, xml string")).collect()
    assert sorted((r["outline_id"], r["name"], r["url"]) for r in rows if r["name"]) == [(1, "One & all", "u1"), (1, "it's", "u2")]
    assert [(r["name"], r["url"]) for r in rows if not r["name"]] == [(None, "u3")]


def test_posts_have_the_platforms_addresses(spark):
    raw = spark.createDataFrame([(1, '{"id": 7, "text": "hi", "entity": "@news"}')], "raw_id long, json string")
    assert I.ingest_posts(raw, "telegram").first()["url"] == "t.me/news/7"


def test_linking_titles_by_claims_and_adds_nodes(spark):
    at = dt.datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, "Hello there. Vaccines cause 5 deaths. Bye.", "en", 0.5, at), (2, "Hello there. Vaccines cause 5 deaths. Bye.", "en", 0.9, at), (3, "same as before", "en", 0.7, at), (4, "no claim here", None, 0.1, at)], "item_id long, text string, language string, confidence double, at timestamp")
    matches = spark.createDataFrame([(3, 100, 0.9)], "item_id long, narrative_id long, similarity double")
    narratives = spark.createDataFrame([(100, "Old story", 0.8, dt.datetime(2023, 1, 1))], "narrative_id long, title string, confidence_score double, last_updated timestamp")
    out = L.link_to_narrative(items, matches, narratives, ["cause"])
    assert sorted(tuple(r) for r in out["links"].select("item_id", "narrative_id", "is_new").collect()) == [(1, -2, True), (2, -2, True), (3, 100, False), (4, -5, True)]
    assert sorted((r["narrative_id"], r["title"], r["confidence_score"]) for r in out["created"].collect()) == [(-5, "no claim here", 0.1), (-2, "Vaccines cause 5 deaths.", 0.9)]
    assert sorted(tuple(r) for r in out["nodes"].collect()) == [("instance", "same as before"), ("narrative", "Old story"), ("narrative", "Vaccines cause 5 deaths."), ("narrative", "no claim here")]
    known = spark.createDataFrame([("narrative", "Old story")], "node_type string, content string")
    assert ("narrative", "Old story") not in {tuple(r) for r in L.link_to_narrative(items, matches, narratives, ["cause"], known)["nodes"].collect()}


def test_belief_networks_hold_active_narratives_only(spark):
    narratives = spark.createDataFrame([(1, "active"), (2, "active"), (3, "archived")], "narrative_id long, status string")
    similar = spark.createDataFrame([(1, 2, 0.6), (1, 3, 0.9)], "a long, b long, similarity double")
    nodes, edges = L.belief_network(narratives, similar, spark.createDataFrame([(1,)], "node long"), similar.select("a", "b").limit(0), 0.5)
    assert [r["node"] for r in nodes.collect()] == [2] and [tuple(r)[:2] for r in edges.collect()] == [(1, 2)]


def reference_seasonality(y, max_period):
    n = len(y)
    d = np.diff(y)
    lags = [float(d[: len(d) - k] @ d[k:]) for k in range(1, min(max_period, n // 3) + 1)]
    acf = np.array(lags) / max(lags)
    peaks = [k for k in range(1, len(acf) - 1) if acf[k] >= 0.3 and acf[k] > acf[k - 1] and acf[k] > acf[k + 1]]
    best = max(peaks, key=lambda k: acf[k])
    return best + 1, acf[best], math.erfc(acf[best] * math.sqrt(n) / math.sqrt(2)), ",".join(str(p + 1) for p in peaks)


def test_seasonality(spark):
    rng = np.random.default_rng(1)
    y = [10 + 5 * (i % 7 == 3) + rng.integers(0, 2) for i in range(70)]
    got = P.seasonality(series(spark, y), 30).first()
    period, strength, p, peaks = reference_seasonality(np.array(y, float), 30)
    assert got["period"] == period and period % 7 == 0 and got["seasonal"] and got["peaks"] == peaks
    assert got["strength"] == pytest.approx(strength) and got["p_value"] == pytest.approx(p, abs=1e-12)
    short = P.seasonality(series(spark, y[:59]), 30).first()
    assert not short["seasonal"] and short["period"] is None and short["p_value"] == 1
    common = {r["period"]: r for r in P.common_periods(series(spark, y), 30).collect()}
    assert set(common) == {1, 7, 14} and common[7]["significant"]
    for z in (0.0, 0.3, 1.96, 4.0, 8.0):
        assert spark.range(1).select(P.two_sided_p(F.lit(z))).first()[0] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)


def test_seasonal_smoothing_repeats_a_season(spark):
    y = [10 + 3 * (i % 7) for i in range(28)]
    rows = P.forecast_holt(series(spark, y), 7, 7).orderBy("step").collect()
    assert [round(r["yhat"], 6) for r in rows] == [10 + 3 * (i % 7) for i in range(7)]
    flat = P.forecast_holt(series(spark, [4.0]), 2).orderBy("step").collect()
    assert [(r["yhat"], r["lower"]) for r in flat] == [(4.0, 4.0)] * 2
    falling = P.forecast_holt(series(spark, [9, 6, 4, 1, 0, 0]), 3).collect()
    assert all(r["lower"] >= 0 for r in falling)


def test_evolution_has_bands_peaks_and_factors(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, "overall", day(1), 7.0), (1, "overall", day(11), 8.0), (1, "logical", day(1), 5.0), (1, "logical", day(11), 4.0), (1, "emotional", day(1), 1.0), (1, "emotional", day(11), 3.0), (2, "overall", day(3), 4.0)]
    made = P.predict_evolution(spark.createDataFrame(rows, "narrative_id long, dimension string, day date, score double"), 7)
    got = {(r["narrative_id"], r["dimension"]): r for r in made.collect()}
    one = got[1, "overall"]
    assert one["yhat"] == pytest.approx(8.7) and one["slope"] == pytest.approx(0.1) and one["r2"] == pytest.approx(1) and one["peak_day"] == day(16)
    assert got[1, "logical"]["direction"] in ("moderate_decrease", "strong_decrease") and got[1, "emotional"]["direction"] == "strong_increase"
    assert got[2, "overall"]["yhat"] == 4 and got[2, "overall"]["direction"] == "stable"
    factors = [(r["narrative_id"], r["factor"]) for r in P.evolution_factors(made).orderBy("narrative_id", "place").collect()]
    assert factors == [(1, "emotional_manipulation is increasing significantly"), (1, "logical_structure is decreasing significantly"), (2, "complexity is relatively stable across all dimensions")]


def test_stored_predictions_skip_malformed_ones_after_the_limit(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, i, at + dt.timedelta(days=i), "[1.0, 2.0]" if i != 5 else "[1.0") for i in range(7)]
    got = P.stored_predictions(spark.createDataFrame(rows, "narrative_id long, prediction_id long, predicted_at timestamp, forecast string"), 3).collect()
    assert sorted(r["prediction_id"] for r in got) == [4, 6]


def test_evidence_documents_keep_nulls_and_leave_empty_content_out(spark):
    rows = [(1, "h", None, None, "text", True, None, "{bad", ""), (2, "h", "u", dt.datetime(2024, 1, 2), "text", False, "m", '{"a": 1}', "body")]
    got = [r["document"] for r in U.evidence_bundle(spark.createDataFrame(rows, "record_id long, content_hash string, source_url string, captured timestamp, content_type string, verified boolean, verification_method string, metadata string, content_data string")).orderBy("record_id").collect()]
    assert got[0] == '{"type":"evidence_record","id":"evidence-1","hash":"h","source_url":null,"capture_date":null,"content_type":"text","verified":true,"verification_method":null,"metadata":{},"version":"1.0"}'
    assert '"capture_date":"2024-01-02T00:00:00"' in got[1] and got[1].endswith('"metadata":{"a":"1"},"version":"1.0","content_data":"body"}')


def test_searches_and_centralities_run_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id long, vector array<double>")
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "rank").collect())
    assert key(V.knn(asked, rows, 3, block=7)) == key(V.knn(asked, rows, 3))
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 20) for i in range(20)] + [(i, i + 20) for i in range(5)], "a long, b long").filter("a <> b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    once = {r["node"]: r["betweenness"] for r in G.betweenness(edges, nodes).collect()}
    parts = {r["node"]: r["betweenness"] for r in G.betweenness(edges, nodes, block=7).collect()}
    assert set(once) == set(parts) and all(abs(once[n] - parts[n]) < 1e-9 for n in once)


def test_signatures_find_nearest(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(1500, 64))
    m[750:] = m[:750] + rng.normal(scale=0.5, size=(750, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    pairs = lambda df: {(r["query_id"], r["id"]) for r in df.collect()}
    exact, found = pairs(V.knn(asked, rows, 3)), pairs(V.signature_search(asked, rows, 3))
    assert len(exact & found) >= 0.9 * len(exact)


def test_features_of_a_tree_add_up(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(800, 3))
    tree = B.Tree(0.4, 4)
    for v in m:
        tree.add(1, v, float(v @ v))
    rows = tree.drained()
    assert rows["n"].sum() == 800 and np.allclose(np.stack(rows["ls"]).sum(0), m.sum(0)) and rows["ss"].sum() == pytest.approx((m * m).sum())
    assert all(B.radius(n, np.array(ls), ss) <= 0.4 + 1e-9 for n, ls, ss in rows.itertuples(index=False)) and len(rows) < 700
    near = spark.createDataFrame([(i, [float(i % 3) * 10, 0.0]) for i in range(90)] + [(90, None)], "id long, vector array<double>").repartition(4)
    features = B.clustering_features(near, 0.5)
    assert sorted(r["n"] for r in features.collect()) == [30, 30, 30]
    labels = {}
    for r in B.birch(near, features, 3).collect():
        labels.setdefault(r["id"] % 3, set()).add(r["cluster"])
    assert all(len(c) == 1 for c in labels.values()) and len(set().union(*labels.values())) == 3


def test_sequences_of_a_day_merge_below_the_limit(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, i, [0.0, 0.1 * i], at(10 * i)) for i in range(3)] + [(1, 10 + i, [0.0, 0.1 * i + 0.25], at(100 + 10 * i)) for i in range(3)] + [(2, 20 + i, [5.0, 0.0], at(i)) for i in range(3)] + [(2, 30, [0.0, 0.0], at(500))]
    got = {r["sequence"]: r for r in C.sequence_clusters(spark.createDataFrame(rows, "key long, id long, vector array<double>, at timestamp")).collect()}
    assert {k: (r["cluster"], r["items"]) for k, r in got.items()} == {0: (0, 3), 10: (0, 3), 20: (20, 3)}
    assert got[0]["confidence"] == pytest.approx(1 / 1.125) and got[20]["confidence"] == 1


def test_outliers_grow_into_cores_and_fade(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "cluster long, kind string, vector array<double>, weight double, created timestamp, at timestamp"
    state = spark.createDataFrame([(1, "core", [0.0, 0.0], 2.0, day(1), day(1)), (2, "outlier", [5.0, 0.0], 1.0, day(1), day(1)), (3, "outlier", [-9.0, 0.0], 1.0, day(1), day(1)), (4, "core", [0.0, 9.0], 1.26, day(1), day(1))], schema)
    batch = spark.createDataFrame([(10, [0.1, 0.0], day(11)), (11, [5.1, 0.0], day(11)), (12, [7.0, 7.0], day(11)), (13, [7.0, 7.1], day(11)), (14, [50.0, 0.0], day(11))], "id long, vector array<double>, at timestamp")
    got = {r["cluster"]: r for r in D.step(state, batch, rate=0.1).collect()}
    assert got[1]["kind"] == "core" and got[1]["weight"] == pytest.approx(2 * 0.5 + 1) and got[1]["vector"][0] == pytest.approx(0.05)
    assert got[2]["kind"] == "core" and got[2]["weight"] == pytest.approx(1.5)  # 0.5 + 1 is above 1.25
    assert 3 not in got and 4 not in got  # half of an item's weight after ten days is too light for them
    assert got[-14]["kind"] == "core" and got[-14]["weight"] == 2 and got[-16]["kind"] == "outlier"
    assert D.fading_rate(0.01, 300, 100) == pytest.approx(0.03) and D.fading_rate(0.01, 1, 100) == 0.01 and D.fading_rate(0.01, 9999, 100) == 0.05
    near = {r["cluster"]: r["merged_into"] for r in D.reassess_outliers(state, 5.0).collect()}
    assert near == {2: 1, 3: None}


def test_moves_reach_the_two_cliques(spark):
    pairs = [(a + 10 * g, b + 10 * g, 1.0) for g in (0, 1) for a in range(5) for b in range(a)] + [(0, 10, 1.0)]
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    labels = G.louvain_communities(edges)
    own = {r["node"]: r["label"] for r in labels.collect()}
    assert len({own[n] for n in range(5)}) == 1 and len({own[n + 10] for n in range(5)}) == 1 and own[0] != own[10]
    assert G.modularity(edges, labels).first()[0] >= G.modularity(edges, G.label_communities(edges)).first()[0] - 1e-12
    central = {(r["measure"], r["place"]): r["node"] for r in G.central_nodes(edges, 2).collect()}
    assert {central["betweenness", 1], central["betweenness", 2]} == {0, 10} == {central["degree", 1], central["degree", 2]}


def test_comments_are_exploded_in_order(spark):
    raw = spark.createDataFrame([(1, '{"comments": [{"id": "a", "text": "x", "author": "p", "publishedAt": "d", "likeCount": 2, "totalReplyCount": 0}, {"id": "b", "text": "y"}, {"id": "c"}]}'), (2, "{}")], "raw_id long, json string")
    assert [(r["raw_id"], r["place"], r["comment_id"], r["likes"]) for r in I.post_comments(raw, 2).orderBy("place").collect()] == [(1, 0, "a", 2), (1, 1, "b", None)]
