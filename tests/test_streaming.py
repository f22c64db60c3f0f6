"""Streams against their batch twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from storyweft.streaming import jobs as R

SCHEMA = "narrative_id long, title string, detected_at timestamp"


def posts(spark, folder):
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 3, f"t{i % 5}", at + dt.timedelta(hours=7 * i)) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def drained(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_daily_counts_equal_batch(spark, tmp_path):
    rows = posts(spark, str(tmp_path / "p"))
    got = drained(spark, R.daily_counts(R.read_posts(spark, str(tmp_path / "p"), SCHEMA)), "daily", "complete")
    want = rows.groupBy("narrative_id", F.date_trunc("day", "detected_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_posts_are_unique(spark, tmp_path):
    posts(spark, str(tmp_path / "p"))
    got = drained(spark, R.first_posts(R.read_posts(spark, str(tmp_path / "p"), SCHEMA), late="60 days"), "firsts")
    assert sorted(r["title"] for r in got.collect()) == [f"t{i}" for i in range(5)]


def test_ingest_once(spark, tmp_path):
    posts(spark, str(tmp_path / "p"))
    for _ in range(2):
        R.ingest(R.read_posts(spark, str(tmp_path / "p"), SCHEMA), str(tmp_path / "c"), str(tmp_path / "out"), None).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_alerts_are_not_repeated(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, p, at + dt.timedelta(minutes=i)) for i, p in enumerate(["low", "low", "high", "high", "low"])]
    schema = "narrative_id long, priority string, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    got = drained(spark, R.deduplicated_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "a"))), "alerts")
    assert [r["priority"] for r in got.orderBy("at").collect()] == ["low", "high", "low"]


def test_micro_clusters_take_whole_batch(spark):
    state = spark.createDataFrame([(1, [1.0, 0.0], 2, 0)], "cluster long, vector array<double>, n long, at long")
    batch = spark.createDataFrame([(1, [0.9, 0.1], 1), (2, [0.0, 1.0], 2), (3, [0.0, 1.0], 3)], "id long, vector array<double>, at long")
    got = {r["cluster"]: r["n"] for r in R.micro_cluster_step(state, batch, 0.2).collect()}
    assert got[1] == 3 and sorted(got.values()) == [2, 3]


def test_sliding_and_session_counts_equal_batch(spark, tmp_path):
    rows = posts(spark, str(tmp_path / "p")).collect()
    stream = R.read_posts(spark, str(tmp_path / "p"), SCHEMA)
    got = drained(spark, R.sliding_counts(stream, "2 days", "1 day"), "sliding", "complete").collect()
    for r in got:
        inside = [x for x in rows if x["narrative_id"] == r["narrative_id"] and r["start"] <= x["detected_at"] < r["start"] + dt.timedelta(days=2)]
        assert r["n"] == len(inside) > 0
    sessions = drained(spark, R.session_counts(stream, "22 hours"), "sessions", "complete").collect()
    assert sum(r["n"] for r in sessions) == 40 and len(sessions) == 3


def test_detection_of_the_last_hour(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    text = "fake news, a secret cure and a miracle treatment: the shocking truth on a conspiracy. It is 1. It is 2. It is 3. " + "x" * 400
    rows = [(1, text, "en", at), (2, text, "en", at + dt.timedelta(hours=5)), (3, "all is well", "en", at + dt.timedelta(hours=5)), (4, "noticias falsas, cura secreta", "es", at + dt.timedelta(hours=5))]
    schema = "narrative_id long, text string, language string, detected_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "d"))
    found = []
    R.detect(spark.readStream.schema(schema).parquet(str(tmp_path / "d")), str(tmp_path / "c"), lambda df, n: found.extend(df.collect()), ["is"], interval=None).awaitTermination(120)
    assert [(r["narrative_id"], round(r["score"], 6)) for r in found] == [(2, 1.0)]


def test_analysis_uses_whole_histories(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "narrative_id long, source_id long, detected_at timestamp"
    rows = [(i % 2, i % 3, at + dt.timedelta(hours=i)) for i in range(12)]
    history = spark.createDataFrame(rows, schema)
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(str(tmp_path / "h"))
    found = []
    R.analyze(spark.readStream.schema(schema).parquet(str(tmp_path / "h")), str(tmp_path / "c"), lambda: history, lambda df, n: found.extend(df.collect())).awaitTermination(120)
    assert [r["narrative_id"] for r in found] == [0]


def test_counter_drafts(spark, tmp_path):
    narratives = spark.createDataFrame([(1, "flat earth again flat earth", "en", 5), (2, "other story", "en", 4), (3, "not touched", "en", 5)], "narrative_id long, text string, language string, threat_level int")
    counters = spark.createDataFrame([(2, "approved")], "narrative_id long, status string")
    spark.createDataFrame([(1,), (2,)], "narrative_id long").coalesce(1).write.parquet(str(tmp_path / "n"))
    found = []
    R.counter(spark.readStream.schema("narrative_id long").parquet(str(tmp_path / "n")), str(tmp_path / "c"), lambda: narratives, lambda: counters, {"en": ("Check {phrase}.",)}, lambda df, n: found.extend(df.collect()), interval=None).awaitTermination(120)
    assert [tuple(r) for r in found] == [(1, "Check flat earth.", "draft")]


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 2)
    schema = "narrative_id long, detected_at timestamp"
    spark.createDataFrame([(1, at), (2, at - dt.timedelta(hours=3))], schema).coalesce(1).write.parquet(str(tmp_path / "l"))
    seen = spark.createDataFrame([(at,)], "at timestamp")
    good, late = [], []
    R.with_late_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "l")), str(tmp_path / "c"), lambda: seen, lambda df, n: good.extend(df.collect()), lambda df, n: late.extend(df.collect())).awaitTermination(120)
    assert [r["narrative_id"] for r in good] == [1] and [r["narrative_id"] for r in late] == [2]


def test_medoids_decay_and_make_room(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    state = spark.createDataFrame([(1, 1, [1.0, 0.0], 1.0, day(1)), (2, 2, [0.0, 1.0], 1.0, day(2))], "cluster long, medoid long, vector array<double>, weight double, at timestamp")
    batch = spark.createDataFrame([(10, [1.0, 0.05], day(11)), (11, [-1.0, 0.0], day(11))], "id long, vector array<double>, at timestamp")
    got = {(r["cluster"], r["medoid"]): r["weight"] for r in R.medoid_step(state, batch, 0.2, 2).collect()}
    assert set(got) == {(1, 1), (1, 10), (-13, 11)} and abs(got[1, 1] - 2.718281828 ** -0.5) < 1e-6


def test_outliers_snapshots_votes_and_reruns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], dt.datetime(2024, 1, 1)), (2, [0.0, 1.0], dt.datetime(2024, 1, 3))], "id long, vector array<double>, at timestamp")
    centres = spark.createDataFrame([(7, [1.0, 0.1])], "cluster long, vector array<double>")
    taken, left = R.retry_outliers(rows, centres, 0.3)
    assert [r["id"] for r in taken.collect()] == [1] and [r["id"] for r in left.collect()] == [2]
    snapshots = spark.createDataFrame([(i, j) for i in range(5) for j in range(2)], "snapshot_id long, x long")
    assert sorted(r["snapshot_id"] for r in R.snapshots_kept(snapshots, 2).collect()) == [3, 3, 4, 4]
    step = lambda df: R.ensemble_step(df, centres, centres.withColumn("weight", F.lit(1.0)), centres)
    full = {r["id"]: r["cluster"] for r in R.rerun(rows, step).collect()}
    assert full == {1: 7, 2: -1}
    assert [r["id"] for r in R.rerun(rows, step, "2024-01-02").collect()] == [2]
    changes = spark.createDataFrame([(1, "started", 1), (1, "done", 2), (2, "started", 1)], "job_id long, status string, at long")
    assert {r["job_id"]: r["status"] for r in R.latest_status(changes).collect()} == {1: "done", 2: "started"}
