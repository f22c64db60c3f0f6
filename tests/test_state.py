"""Stateful jobs against a fold over the same rows, across restarts; plugin sources; run metrics."""

from __future__ import annotations

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.streaming import state as S

pytest.importorskip("google.protobuf")  # state variables talk to Spark in it
ITEMS = "id long, vector array<double>, at timestamp"
START = dt.datetime(2024, 1, 1)


def in_runs(spark, job, rows, folder, schema, cuts):
    """Give a job the rows in several runs of a query with one checkpoint; returns all it gave."""
    source, out = f"{folder}/in", f"{folder}/out"
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = job(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", out).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240), k
    return spark.read.parquet(out).collect()


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4))
    return [(i, (centres[rng.integers(6)] * (1 + (i > 60)) + rng.normal(scale=0.1, size=4)).tolist(), START + dt.timedelta(hours=3 * i)) for i in range(130)]


def milliseconds(at):
    return int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def test_medoids_fade_evict_and_survive_restarts(spark, tmp_path, items):
    got = in_runs(spark, lambda s: S.medoid_clusters(s, 1, threshold=0.05, k=3, p=2, every="2 days", late="0 seconds"), items, str(tmp_path), ITEMS, [50, 90])
    given = {r["id"]: (r["cluster"], r["distance"]) for r in got if r["id"] is not None}
    assert set(given) == set(range(130))
    assert len({c for c, _ in given.values()}) > 3  # some clusters made room
    faded = [r for r in got if r["id"] is None]
    assert faded and all(0 < r["distance"] <= 2 for r in faded)
    # The same folded at once, fading where the timers did: after each micro-batch, up to its watermark.
    model, want, due = S.Medoids(0.05, 3, 2, 0.05), {}, None
    for k, (i, v, at) in enumerate(items):
        if k in (50, 90):
            while due <= milliseconds(items[k - 1][2]):
                model.tick(due)
                due += 2 * S.DAY_MS * max(1, -(-(milliseconds(items[k - 1][2]) + 1 - due) // (2 * S.DAY_MS)))
        want[i] = model.add(i, v, milliseconds(at))
        if due is None:
            model.faded = milliseconds(at)
            due = model.faded + 2 * S.DAY_MS
    assert {i: c for i, (c, _) in given.items()} == {i: c for i, (c, _) in want.items()}
    assert all(abs(given[i][1] - want[i][1]) < 1e-9 for i in want)


def test_medoid_weights_fade_by_age():
    model = S.Medoids(0.3, 2, 5, 0.05)
    model.add(1, [1.0, 0.0], 1)
    model.faded = 1
    model.tick(1 + 10 * S.DAY_MS)
    assert model.clusters[1][1][0][2] == pytest.approx(math.exp(-0.5))
    assert model.add(2, [0.0, 1.0], 2) == (2, 0.0) and model.add(3, [-1.0, 0.0], 3)[0] == 3
    assert set(model.clusters) == {2, 3}  # the least recently used one went


def test_micro_clusters_retry_outliers_and_note_snapshots(spark, tmp_path, items):
    settings = (0.6, 3, 10, 25, 3)
    got = in_runs(spark, lambda s: S.micro_clusters(s, 1, *settings), items, str(tmp_path), ITEMS, [33, 34, 101])
    model, want = S.MicroClusters(*settings), []
    for i, v, at in items:
        want += model.add(i, v, milliseconds(at))
    assert sorted((r["id"], r["cluster"]) for r in got) == sorted(want)
    assert any(c == -1 for _, c in want) and len(model.clusters) == 3 and len(model.snapshots) == 3
    assert max(r["seen"] for r in got) == 130 and max(r["snapshots"] for r in got) == 3


def test_outliers_join_what_grows_towards_them():
    model = S.MicroClusters(1.0, 1, 5)
    model.add(0, [0.0], 0)
    assert model.add(1, [1.4], 1) == [(1, -1)]
    model.add(2, [0.9], 2)
    model.add(3, [0.9], 3)
    assert model.add(4, [0.9], 4) == [(4, 0), (1, 0)] and not model.outliers


def test_alerts_honour_thresholds_that_change(spark, tmp_path):
    from storyweft.sources import archives

    archives.register(spark)
    limits, source = tmp_path / "limits", str(tmp_path / "in")
    os.makedirs(limits)

    def allow(**values):
        (limits / "now.json").write_text("\n".join(json.dumps({"dimension": d, "limit": v}) for d, v in values.items()))

    schema = "narrative_id long, overall double, emotional double, logical double, at timestamp"
    at = lambda n: START + dt.timedelta(minutes=n)
    batches = [[(1, 6.0, 1.0, 1.0, at(0)), (2, 4.0, 1.0, 1.0, at(0))], [(1, 6.0, 1.0, 1.0, at(1)), (2, 4.0, 5.0, 1.0, at(1))], [(1, 6.0, 6.0, 6.0, at(2)), (2, 4.0, 1.0, 1.0, at(2))]]
    found = []
    for batch, values in zip(batches, ((5, 5, 5), (3, 4, 5), (3, 4, 5)), strict=True):
        allow(overall=values[0], emotional=values[1], logical=values[2])
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        job = S.threshold_alerts(spark.readStream.schema(schema).parquet(source), spark.read.format("alert_thresholds").load(str(limits)), "1 hour")
        query = job.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: found.extend((r["narrative_id"], r["priority"], r["at"]) for r in df.collect())).outputMode("append").trigger(availableNow=True).start()
        ended = query.awaitTermination(90)
        query.stop()
        assert ended
    assert sorted(found) == [(1, "high", at(2)), (1, "low", at(0)), (2, "low", at(2)), (2, "medium", at(1))]


def test_archives_in_batch_and_as_a_stream(spark, tmp_path):
    from storyweft.operators.ingest import parse_feed_items
    from storyweft.sources import archives

    assert {"feed_archive", "page_archive"} <= set(archives.register(spark))
    folder, out = tmp_path / "pages", str(tmp_path / "out")
    os.makedirs(folder)

    def page(name, *ids):
        (folder / name).write_text("\n".join([*(json.dumps({"page_id": i, "url": f"u{i}", "html": f"<p>{i}</p>"}) for i in ids), "no page", "[1]"]))

    def run():
        query = spark.readStream.format("page_archive").load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["page_id"] for r in spark.read.parquet(out).collect())

    page("a.json", 1, 2)
    assert run() == [1, 2]
    page("b.json", 3)
    os.utime(folder / "b.json", (2e9, 2e9))
    assert run() == [1, 2, 3]  # a restart reads what is new, once
    assert run() == [1, 2, 3]
    assert sorted(tuple(r) for r in spark.read.format("page_archive").load(str(folder)).collect()) == [(i, f"u{i}", f"<p>{i}</p>") for i in (1, 2, 3)]
    feeds = tmp_path / "feeds"
    os.makedirs(feeds)
    (feeds / "x.xml").write_text("<rss><channel><title>F</title><item><title>T</title><link>l</link></item></channel></rss>")
    rows = parse_feed_items(spark.read.format("feed_archive").load(str(feeds)), 5).collect()
    assert [(r["feed_title"], r["title"], r["link"], r["content"]) for r in rows] == [("F", "T", "l", "")]


def test_sql_names_are_inlined(spark):
    from storyweft.functions import sql

    sql.register(spark)
    df = spark.sql("SELECT clean_text(t) AS a, normalize_date(t) AS b, url_domain(t) AS c, detect_language(t) AS d FROM VALUES ('Don''t  <b>go</b> to www.x.y, it is on the list for that!') AS v(t)")
    assert tuple(df.first())[0] == "dont go to it is on the list for that" and df.first()["d"] == "en"
    assert "Python" not in df._jdf.queryExecution().toString()


def test_run_metrics_of_a_stream(spark, tmp_path):
    from storyweft.operators.linking import observed, run_metrics
    from storyweft.streaming.metrics import CycleListener, read_cycles

    listener = CycleListener(f"file://{tmp_path}/cycles")
    spark.streams.addListener(listener)
    try:
        for name, fails in (("good", False), ("bad", True)):
            spark.range(5).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
            stream = spark.readStream.schema("id long").parquet(str(tmp_path / f"in-{name}"))

            def sink(df, n, fails=fails):
                df.count()
                if fails:
                    raise ValueError("no sink")

            query = stream.writeStream.queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).foreachBatch(sink).trigger(availableNow=True).start()
            try:
                query.awaitTermination(120)
            except Exception:
                assert fails
        listener.settle(2, 30)
    finally:
        spark.streams.removeListener(listener)
    rows = {r["agent"]: r for r in run_metrics(read_cycles(spark, f"file://{tmp_path}/cycles")).collect()}
    assert rows["good"]["rows"] == 5 and rows["good"]["errors"] == 0 and rows["good"]["longest"] > 0
    assert rows["bad"]["errors"] == 1
    df, seen = observed(spark.createDataFrame([(1,), (None,)], "id long"), "seen")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "errors": 1}
    assert F.lit(1) is not None
