"""Structured Streaming jobs; their batch twins are the operators that they call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = "narrative_id"


def read_posts(spark: SparkSession, folder: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Posts as they land as Parquet files in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def daily_counts(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling daily counts by narrative."""
    return posts.withWatermark("detected_at", late).groupBy(F.window("detected_at", "1 day"), KEY).agg(F.count(F.lit(1)).alias("n")).select(KEY, F.col("window.start").alias("day"), "n")


def sliding_counts(posts: DataFrame, width: str = "14 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sliding period counts by narrative, the current and previous period of trending."""
    return posts.withWatermark("detected_at", late).groupBy(F.window("detected_at", width, slide), KEY).agg(F.count(F.lit(1)).alias("n")).select(KEY, F.col("window.start").alias("start"), "n")


def session_counts(posts: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sequences of posts with smaller gaps than given."""
    return posts.withWatermark("detected_at", late).groupBy(F.session_window("detected_at", gap), KEY).agg(F.count(F.lit(1)).alias("n")).select(KEY, F.col("session_window.start").alias("start"), "n")


def first_posts(posts: DataFrame, key: str = "title", late: str = "1 day") -> DataFrame:
    """The first post of each key within the watermark: a narrative is created once."""
    return posts.withWatermark("detected_at", late).dropDuplicatesWithinWatermark([key])


def detect_stream(posts: DataFrame, verbs: Sequence[str], phrases: dict[str, Sequence[str]] | None = None, threshold: float = 0.75) -> DataFrame:
    """Language, score and flag of each post as it arrives, by the phrases of its language (a narrow job)."""
    from storyweft.functions.text import detect_language, is_claim, sentences
    from storyweft.operators.text import INDICATORS, score_columns

    claims = F.size(F.filter(sentences(F.col("text")), lambda s: is_claim(s, verbs)))
    rows = posts if "language" in posts.columns else posts.withColumn("language", detect_language(F.col("text")))
    return rows.withColumn("score", score_columns(claims, phrases or INDICATORS)).withColumn("flagged", F.col("score") >= threshold)


def detect(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], verbs: Sequence[str], hours: float = 1.0, interval: str | None = "300 seconds", **options) -> StreamingQuery:
    """Hand the flagged posts of each micro-batch's last hour to a sink."""

    def step(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max("detected_at").alias("newest"))  # one row
        recent = batch.join(F.broadcast(newest)).filter(F.unix_micros(F.col("detected_at").cast("timestamp")) >= F.unix_micros(F.col("newest").cast("timestamp")) - int(hours * 3.6e9)).drop("newest")
        sink(detect_stream(recent, verbs, **options).filter("flagged"), number)

    return run_into(stream, checkpoint, step, interval)


def counter(stream: DataFrame, checkpoint: str, narratives: Callable[[], DataFrame], counters: Callable[[], DataFrame], templates: dict[str, Sequence[str]], sink: Callable[[DataFrame, int], None], most: int = 5, interval: str | None = "900 seconds") -> StreamingQuery:
    """With each micro-batch, write drafts for the most threatening narratives (with text and language) that lack an approved counter."""
    from storyweft.operators.joins import uncountered
    from storyweft.operators.text import template_counter

    def step(batch: DataFrame, number: int) -> None:
        touched = batch.select(KEY).distinct()
        open_ones = uncountered(narratives().join(touched, KEY, "left_semi"), counters(), most)
        sink(template_counter(open_ones.select(KEY, "text", "language"), templates).withColumn("status", F.lit("draft")), number)

    return run_into(stream, checkpoint, step, interval)


def with_late_rows(stream: DataFrame, checkpoint: str, latest: Callable[[], DataFrame], on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], hours: float = 1.0, interval: str | None = None) -> StreamingQuery:
    """Part each micro-batch: rows more than so many hours before the latest seen so far (one row, column ``at``) go to a side table."""

    def step(batch: DataFrame, number: int) -> None:
        seen = latest().agg(F.max("at").alias("seen"))  # one row
        marked = batch.join(F.broadcast(seen)).withColumn("is_late", F.coalesce(F.unix_micros(F.col("detected_at").cast("timestamp")) < F.unix_micros(F.col("seen").cast("timestamp")) - int(hours * 3.6e9), F.lit(False))).drop("seen")
        on_time(marked.filter("NOT is_late").drop("is_late"), number)
        late(marked.filter("is_late").drop("is_late"), number)

    return run_into(stream, checkpoint, step, interval)


def deduplicated_alerts(alerts: DataFrame, quiet: str = "5 minutes") -> DataFrame:
    """Alerts (narrative_id, priority, at) without those that repeat a narrative's last priority; state ends after silence."""
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for rows in batches:
            for row in rows.sort_values("at").itertuples(index=False):
                if row.priority != last:
                    kept.append((key[0], row.priority, row.at))
                    last = row.priority
        state.update((last,))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(kept, columns=[KEY, "priority", "at"])

    return alerts.groupBy(KEY).applyInPandasWithState(step, f"{KEY} long, priority string, at timestamp", "priority string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_into(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Start a job that hands each micro-batch to a batch function; without an interval it takes what is there and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def ingest(stream: DataFrame, checkpoint: str, path: str, interval: str | None = "120 seconds") -> StreamingQuery:
    """Append posts to a table partitioned by day; a batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("detected_at")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return run_into(stream, checkpoint, write, interval)


def analyze(stream: DataFrame, checkpoint: str, history: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Recompute propagation of the narratives that a micro-batch touches, from their whole history."""
    from storyweft.operators.aggregates import propagation

    def step(batch: DataFrame, number: int) -> None:
        touched = batch.select(KEY).distinct()
        sink(propagation(history().join(touched, KEY, "left_semi")), number)

    return run_into(stream, checkpoint, step, interval)


def micro_cluster_step(state: DataFrame, batch: DataFrame, radius: float) -> DataFrame:
    """State (cluster, vector, n, at) after a micro-batch (id, vector, at): rows within the radius join the nearest
    cluster's running mean; the rest are clustered by density and become new ones.

    The whole batch is judged by the state at its start, so the result doesn't depend on the order in it.
    """
    from storyweft.operators.vectors import assign_or_new, dbscan, mean_vectors

    near = assign_or_new(batch, state.select("cluster", "vector"), radius)
    rows = batch.join(near.select("id", "cluster"), "id")
    left = rows.filter("cluster = -1").select("id", "vector")
    new = dbscan(left, radius, 2).join(batch, "id").filter("cluster <> -1").withColumn("cluster", -F.col("cluster") - 2)
    joined = rows.filter("cluster <> -1").unionByName(new.select(*rows.columns))
    sums = mean_vectors(joined, "cluster").join(joined.groupBy("cluster").agg(F.max("at").alias("at")), "cluster")
    both = state.select("cluster", "vector", F.col("n").alias("size"), "at").unionByName(sums.select("cluster", "vector", "size", "at"))
    long = both.select("cluster", "size", F.posexplode("vector").alias("i", "x")).groupBy("cluster", "i").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("m"))
    centre = long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    return centre.join(both.groupBy("cluster").agg(F.sum("size").alias("n"), F.max("at").alias("at")), "cluster")


def medoid_step(state: DataFrame, batch: DataFrame, threshold: float, k: int, rate: float = 0.05) -> DataFrame:
    """Medoid state (cluster, medoid, vector, weight, at) after a micro-batch (id, vector, at).

    Weights fall with age up to the batch's newest time. A row within the threshold of a cluster refreshes
    it as a medoid of weight 1; all others become clusters of their own. The ``k`` clusters used last stay.
    The whole batch is judged by the state at its start.
    """
    from storyweft.operators.clusters import decayed_medoids, least_recent
    from storyweft.operators.vectors import medoid_assign

    now = batch.unionByName(state.select(F.col("medoid").alias("id"), "vector", "at")).agg(F.max("at").alias("now")).first()["now"]  # one value
    old = decayed_medoids(state, F.lit(now).cast("timestamp"), rate).drop("place")
    near = medoid_assign(batch.select("id", "vector"), old.select("cluster", "vector", "weight"), threshold)
    rows = batch.join(near.select("id", "cluster"), "id")
    new = rows.select(F.when(F.col("cluster") == -1, -F.col("id") - 2).otherwise(F.col("cluster")).cast("long").alias("cluster"), F.col("id").alias("medoid"), "vector", F.lit(1.0).alias("weight"), "at")
    both = old.select(*new.columns).unionByName(new)
    kept = least_recent(both.groupBy("cluster").agg(F.max("at").alias("last_updated")), k)
    return both.join(kept.select("cluster"), "cluster", "left_semi")


def retry_outliers(buffer: DataFrame, centroids: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(assigned, left): buffered outliers (id, vector) that a current centre now takes, and those still out."""
    from storyweft.operators.vectors import assign_or_new

    near = assign_or_new(buffer.select("id", "vector"), centroids, limit)
    rows = buffer.join(near.select("id", "cluster"), "id")
    return rows.filter("cluster <> -1"), rows.filter("cluster = -1").drop("cluster")


def snapshots_kept(snapshots: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` snapshots (snapshot_id, ...) of a state table; earlier ones are dropped."""
    numbers = snapshots.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(keep)
    return snapshots.join(F.broadcast(numbers), "snapshot_id", "left_semi")  # ``keep`` rows


def ensemble_step(batch: DataFrame, centroids: DataFrame, medoids: DataFrame, micro: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), limit: float = 0.6) -> DataFrame:
    """One cluster for each item of a micro-batch (id, vector): centroid, medoid and micro cluster assignments vote.

    The same function over a whole table, or over its recent part, is the full and the recent re-run.
    """
    from storyweft.operators.vectors import assign_or_new, ensemble_vote, medoid_assign

    rows = batch.select("id", "vector")
    a = assign_or_new(rows, centroids, limit).select("id", "cluster", (1 - F.col("distance")).alias("confidence"), F.lit(weights[0]).alias("weight"))
    b = medoid_assign(rows, medoids, limit).select("id", "cluster", "confidence", F.lit(weights[1]).alias("weight"))
    c = assign_or_new(rows, micro, limit).select("id", "cluster", (1 - F.col("distance")).alias("confidence"), F.lit(weights[2]).alias("weight"))
    votes = [v.select("id", F.col("cluster").cast("long").alias("cluster"), "confidence", "weight") for v in (a, b, c)]
    return ensemble_vote(votes[0].unionByName(votes[1]).unionByName(votes[2]))


def rerun(items: DataFrame, step: Callable[[DataFrame], DataFrame], since: str | None = None) -> DataFrame:
    """A batch re-run of a step over all items, or those from a time on (column ``at``)."""
    return step(items if since is None else items.filter(F.col("at") >= F.lit(since).cast("timestamp")))


def latest_status(changes: DataFrame) -> DataFrame:
    """Latest status of each job from its change stream (batch or complete mode)."""
    return changes.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
