"""Hand-computed cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as X
from storyweft.operators import aggregates as A
from storyweft.operators import alerts as L
from storyweft.operators import forecast as P
from storyweft.operators import graph as G
from storyweft.operators import reliability as Q
from storyweft.operators import series as S
from storyweft.operators import vectors as V


def series(spark, *values, key=1):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(key, day + dt.timedelta(i), v) for i, v in enumerate(values)], "narrative_id long, day date, n long")


def column(df, name):
    return [r[name] for r in df.orderBy("day").collect()]


def test_growth(spark):
    rows = S.growth_rate(series(spark, 2, 0, 1))
    assert column(rows, "cumulative") == [2, 2, 3]
    assert column(rows, "rate") == [0, 0, 0.5]


def test_smoothing(spark):
    assert column(S.smooth_mean(series(spark, 1, 2, 3, 4), 3), "smooth") == [1.5, 2, 3, 3.5]
    assert column(S.smooth_exponential(series(spark, 2, 4, 8), 3), "smooth") == [2, 3, 5.5]


def test_change_points_need_variance(spark):
    assert S.change_points(series(spark, *[0] * 5, *[10] * 5), 5, 2.0).count() == 0


def test_short_trend_has_no_data(spark):
    row = P.linear_trend(series(spark, 1, 5)).first()
    assert row["direction"] == "no_data"


def test_propagation(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, i % 2, at + dt.timedelta(hours=5 * i / 9)) for i in range(10)] + [(2, 1, at)]
    df = spark.createDataFrame(rows, "narrative_id long, source_id long, detected_at timestamp_ntz")
    got = {r["narrative_id"]: r for r in A.propagation(df).collect()}
    assert got[1]["velocity"] == pytest.approx(2) and got[1]["score"] == pytest.approx(0.4) and got[1]["threat"] == 2
    assert got[2]["velocity"] == 0 and got[2]["threat"] == 1


def test_reliability(spark):
    df = spark.createDataFrame([(0,), (7,), (25,)], "n int").select(Q.reliability(F.col("n")).alias("r"))
    assert [r["r"] for r in df.collect()] == [100, 65, 0]


def test_what_if(spark):
    forecast = spark.createDataFrame([(1, s, 1.0) for s in (1, 2, 3)], "narrative_id long, step int, yhat double")
    plan = spark.createDataFrame([(1, "decay", 2, -0.5, 0.5)], "narrative_id long, kind string, from_step int, impact double, decay double")
    assert [r["changed"] for r in P.what_if(forecast, plan).orderBy("step").collect()] == [1, 0.5, 0.75]


def test_complexity_series(spark):
    assert column(P.complexity_series(series(spark, 0, 4)), "complexity") == [0.3, 1.0]


def test_dimension_similarity(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "cluster int, d string")
    assert A.dimension_similarity(df, "cluster", ["d"]).first()["similarity"] == pytest.approx(1 / 3)


def test_vote(spark):
    df = spark.createDataFrame([(1, 1, 0.8, 0.4), (1, 1, 0.7, 0.3), (1, 2, 0.9, 0.3), (2, -1, 0.9, 1.0)], "id long, cluster long, confidence double, weight double")
    got = {r["id"]: r for r in V.ensemble_vote(df).collect()}
    assert got[1]["cluster"] == 1 and got[1]["confidence"] == pytest.approx(0.68875)
    assert got[2]["is_outlier"] and got[2]["cluster"] == -1


def test_alert_priority(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "n int").select(L.priority(F.col("n"), F.lit(False)).alias("p"))
    assert [r["p"] for r in df.collect()] == ["none", "low", "medium", "high"]


def test_dates_and_json(spark):
    df = spark.createDataFrame([("03/04/2024",), ("13/04/2024",), ("x",), ("2024-01-02T03:04:05Z",), ("05-01-2024",), ("20240105",), ("Jan 5, 2024",), ("January 5, 2024",), ("",), (None,)], "d string").select(X.normalize_date(F.col("d")).alias("d"))
    assert [r["d"] for r in df.collect()] == ["2024-03-04T00:00:00", "2024-04-13T00:00:00", "x", "2024-01-02T03:04:05", "2024-01-05T00:00:00", "20240105", "Jan 5, 2024", "2024-01-05T00:00:00", None, None]
    df = spark.createDataFrame([(None,), ("{bad",), ('{"a":1}',)], "m string").select(X.meta_get(F.col("m"), "$.a", F.lit("0")).alias("a"))
    assert [r["a"] for r in df.collect()] == ["0", "0", "1"]


def test_credibility(spark):
    distinct, repeated = " ".join(f"w{i}" for i in range(100)), "word " * 300
    rows = [("https://x.gov/a", distinct, 0), ("https://www.bbc.co.uk/a", repeated, 6), ("https://a.edu/", repeated, 1), ("https://a.org/", "", 0), ("https://a.com/", distinct, 5)]
    got = [r["s"] for r in spark.createDataFrame(rows, "u string, t string, n int").select(X.credibility_score(F.col("u"), F.col("t"), F.col("n")).alias("s")).collect()]
    # .4 tier + .3 (.7 above 1000 characters, else .5) + .15 min(1, 2 distinct / words) + .15 links (.8, .6, .4)
    want = [0.4 * 0.85 + 0.15 + 0.15 + 0.06, 0.4 * 0.9 + 0.21 + 0.15 * 2 / 300 + 0.12, 0.4 * 0.8 + 0.21 + 0.15 * 2 / 300 + 0.09, 0.4 * 0.7 + 0.15 + 0 + 0.06, 0.4 * 0.5 + 0.15 + 0.15 + 0.09]
    assert got == [pytest.approx(round(x, 2)) for x in want]


def test_relevance_counts_parts_of_words(spark):
    df = spark.createDataFrame([("A fake News item, fake newsroom",), ("one two",), ("",)], "t string")
    assert [r["s"] for r in df.select(X.relevance(F.col("t"), ["fake news"]).alias("s")).collect()] == [1.0, 0.0, 0.0]


def test_language_markers(spark):
    df = spark.createDataFrame([("it is on for us",), ("it is with us and",), ("",)], "t string")
    assert [r["s"] for r in df.select(X.detect_language(F.col("t")).alias("s")).collect()] == ["en", "unknown", "unknown"]


def test_entities(spark):
    df = spark.createDataFrame([("Met John Smith in New York on 5 March 2024, then Big Red Group at 1/2/24.",)], "t string")
    got = df.select(*(X.entities(F.col("t"), k).alias(k) for k in X.ENTITY_PATTERNS)).first()
    assert got["persons"] == ["Big Red Group", "Met John Smith", "New York"] and got["organizations"] == ["Big Red Group"]
    assert got["locations"] == ["New York"] and got["dates"] == ["1/2/24", "5 March 2024"]


def test_impact_and_recommendation(spark):
    df = spark.createDataFrame([(10, 20.0), (20, 5.0)], "n int, g double").select(V.impact_score(F.col("n"), F.col("g"), F.lit(0.0), F.lit(0.5), F.lit(0.0)).alias("s"))
    assert [r["s"] for r in df.collect()] == [pytest.approx(0.3 * 0.5 + 0.3 + 0.05), pytest.approx(0.3 / (1 + 2.718281828459045**-1) + 0.15 + 0.05)]
    rows = [(5, 0.9, False), (5, 0.3, False), (5, 0.9, True), (3, 0.9, False), (3, 0.3, False), (0, 0.9, False), (0, 0.9, True), (1, 0.2, False)]
    got = spark.createDataFrame(rows, "t int, c double, n boolean").select(V.recommendation(F.col("t"), F.col("c"), F.col("n")).alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [("high", "monitor_and_counter"), ("high", "monitor_and_counter"), ("high", "review"), ("medium", "monitor"), ("medium", "review"), ("low", "routine"), ("medium", "review"), ("low", "review")]


def test_key_factors(spark):
    df = spark.createDataFrame([(1, 0.55, 0.9, 0.4, -0.3, None)], "narrative_id long, centrality double, connection_strength double, consistency double, growth double, source_diversity double")
    got = [(r["factor"], r["impact"]) for r in P.key_factors(df).orderBy("place").collect()]
    assert got == [("Connection Strength", 1.0), ("Network Centrality", pytest.approx(0.5)), ("Growth Rate", pytest.approx(-0.5)), ("Consistency", 0.0), ("Source Diversity", 0.0)]


def test_frequent_pairs_meet_in_chunks(spark):
    from storyweft.operators.joins import pairs_within

    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(40)], "k long, i long")
    assert pairs_within(rows, "k", "i", chunk=7).count() == pairs_within(rows, "k", "i", chunk=7).distinct().count() == 2 * 40 * 39 / 2


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "node long")
    got = {r["node"]: r["betweenness"] for r in G.betweenness(edges, nodes).collect()}
    assert got[2] == 2 and got[3] == 2 and got.get(1, 0) == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in G.strong_components(edges).collect()}
    assert got[1] == got[2] == got[3] != got[4]
