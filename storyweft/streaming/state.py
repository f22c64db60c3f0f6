"""Arbitrary state as Spark state variables: medoid clusters, micro-clusters with an outlier buffer, alerts.

Each job is a stateful processor over a shard of the items. Its state lives in the RocksDB state store,
checkpointed with the query, so a restart goes on where the last micro-batch ended. What a processor does
with a shard's rows is a plain class on plain values, which tests fold over the same rows in one go.

A shard's state is bounded: at most ``k`` clusters of ``p`` medoids, or ``most`` micro-clusters, a buffer
of ``buffer`` outliers from which the oldest go, and ``keep`` snapshots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """State variables need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    scale = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1 - float(a @ b) / scale if scale else 1.0


# Medoid clusters ------------------------------------------------------------------------------------


@dataclass
class Medoids:
    """At most ``k`` clusters of at most ``p`` weighted medoids, of one shard.

    An item within ``threshold`` of a cluster (weighted mean cosine distance to its medoids) becomes its
    medoid of weight 1; the heaviest ``p`` stay. Any other item opens a cluster, in place of the least
    recently used one when there are ``k``. Weights fade by ``exp(-rate * days)`` up to the time of a tick.
    """

    threshold: float = 0.3
    k: int = 10
    p: int = 5
    rate: float = 0.05
    #: cluster -> (last used in ms, list of [item, vector, weight])
    clusters: dict[int, tuple[int, list[list]]] = field(default_factory=dict)
    faded: int = 0

    def distance(self, medoids: list[list], vector: np.ndarray) -> float:
        total = sum(m[2] for m in medoids)
        return sum(m[2] * _cosine(np.asarray(m[1]), vector) for m in medoids) / total if total > 0 else math.inf

    def add(self, item: int, vector: list[float], at: int) -> tuple[int, float]:
        """(cluster, distance) of an item: a new cluster is named after its first item, at distance 0."""
        own = np.asarray(vector, float)
        near = min(((self.distance(m, own), c) for c, (_, m) in self.clusters.items()), default=(math.inf, 0))
        if near[0] <= self.threshold:
            medoids = self.clusters[near[1]][1]
            medoids.append([item, list(vector), 1.0])
            medoids.sort(key=lambda m: -m[2])
            self.clusters[near[1]] = (at, medoids[: self.p])
            return near[1], near[0]
        if len(self.clusters) >= self.k:
            del self.clusters[min(self.clusters, key=lambda c: (self.clusters[c][0], c))]
        self.clusters[item] = (at, [[item, list(vector), 1.0]])
        return item, 0.0

    def tick(self, now: int) -> None:
        """Fade all weights up to a time."""
        if self.faded and now > self.faded:
            share = math.exp(-self.rate * (now - self.faded) / DAY_MS)
            for _, medoids in self.clusters.values():
                for m in medoids:
                    m[2] *= share
        self.faded = max(self.faded, now)


class MedoidProcessor(StatefulProcessor):
    """Medoid clusters of a shard: a map from cluster to its medoids; a timer fades them each ``every_ms`` of the watermark."""

    def __init__(self, threshold: float, k: int, p: int, rate: float, every_ms: int):
        self.settings, self.every_ms = (threshold, k, p, rate), every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "cluster long", "used long, items array<long>, vectors array<array<double>>, weights array<double>")
        self.clock = handle.getValueState("clock", "faded long")

    def _held(self) -> Medoids:
        model = Medoids(*self.settings)
        for (cluster,), (used, items, vectors, weights) in self.clusters.iterator():
            model.clusters[cluster] = (used, [[i, list(v), w] for i, v, w in zip(items, vectors, weights, strict=True)])
        model.faded = self.clock.get()[0] if self.clock.exists() else 0
        return model

    def _keep(self, model: Medoids) -> None:
        gone = [c for (c,) in self.clusters.keys() if c not in model.clusters]
        for c in gone:
            self.clusters.removeKey((c,))
        for c, (used, medoids) in model.clusters.items():
            self.clusters.updateValue((c,), (used, [m[0] for m in medoids], [m[1] for m in medoids], [m[2] for m in medoids]))
        self.clock.update((model.faded,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model, out = self._held(), []
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        for item, vector, at in zip(batch["id"], batch["vector"], batch["at"], strict=True):
            out.append((int(key[0]), int(item), *model.add(int(item), list(vector), int(at.value // 1_000_000))))
        if not model.faded:
            model.faded = int(batch["at"].iloc[0].value // 1_000_000)
            self.handle.registerTimer(model.faded + self.every_ms)
        self._keep(model)
        yield pd.DataFrame(out, columns=["shard", "id", "cluster", "distance"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        model = self._held()
        due = expiredTimerInfo.getExpiryTimeInMs()
        model.tick(due)
        self._keep(model)
        now = timerValues.getCurrentWatermarkInMs()
        self.handle.registerTimer(due + self.every_ms * max(1, -(-(now + 1 - due) // self.every_ms)))
        yield pd.DataFrame([(int(key[0]), None, c, sum(m[2] for m in medoids)) for c, (_, medoids) in sorted(model.clusters.items())], columns=["shard", "id", "cluster", "distance"]).astype({"id": "Int64"})


def sharded(items: DataFrame, shards: int) -> DataFrame:
    """Items (id, vector, at) with a shard: each shard keeps clusters of its own, so state and work spread."""
    return items.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long"))


def medoid_clusters(items: DataFrame, shards: int = 8, threshold: float = 0.3, k: int = 10, p: int = 5, rate: float = 0.05, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Stream of (shard, id, cluster, distance) of items (id, vector, at); rows without id give a cluster's weight after each fading."""
    use_state_store(items.sparkSession)
    every_ms = int(pd.Timedelta(every).total_seconds() * 1000)
    rows = sharded(items, shards).withWatermark("at", late)
    return rows.groupBy("shard").transformWithStateInPandas(MedoidProcessor(threshold, k, p, rate, every_ms), "shard long, id long, cluster long, distance double", "append", "eventtime")


# Micro-clusters with an outlier buffer ---------------------------------------------------------------


@dataclass
class MicroClusters:
    """Micro-clusters (n, mean, squared deviation, last) of one shard, a buffer of items that none takes, and snapshots.

    An item joins the nearest cluster within ``epsilon``, or within three radii if that is less; otherwise it opens a
    cluster while there are fewer than ``most``, and waits as an outlier after that. Every ``retry`` items the
    buffered ones are tried again, and every ``snapshot`` items the clusters are noted; the newest ``keep`` notes stay.
    """

    epsilon: float = 0.3
    most: int = 100
    retry: int = 50
    snapshot: int = 1000
    keep: int = 100
    buffer: int = 10_000
    clusters: dict[int, list] = field(default_factory=dict)  # name -> [n, mean, sse, last]
    outliers: list[tuple[int, list[float], int]] = field(default_factory=list)
    snapshots: list[tuple[int, int, int]] = field(default_factory=list)  # (seen, clusters, items in them)
    seen: int = 0

    def _join(self, vector: list[float], at: int) -> int:
        own = np.asarray(vector, float)
        near = min(((float(np.linalg.norm(np.asarray(c[1]) - own)), name) for name, c in self.clusters.items()), default=None)
        if near is None:
            return -1
        c = self.clusters[near[1]]
        limit = min(self.epsilon, 3 * math.sqrt(c[2] / c[0])) if c[0] > 1 and c[2] > 0 else self.epsilon
        if near[0] > limit:
            return -1
        mean = np.asarray(c[1]) + (own - np.asarray(c[1])) / (c[0] + 1)
        c[2] += float((own - np.asarray(c[1])) @ (own - mean))
        c[0], c[1], c[3] = c[0] + 1, mean.tolist(), max(c[3], at)
        return near[1]

    def add(self, item: int, vector: list[float], at: int) -> list[tuple[int, int]]:
        """(item, cluster) of this item, and of outliers that a retry assigned."""
        self.seen += 1
        name = self._join(vector, at)
        if name < 0 and len(self.clusters) < self.most:
            self.clusters[item] = [1, list(vector), 0.0, at]
            name = item
        if name < 0:
            self.outliers = [*self.outliers, (item, list(vector), at)][-self.buffer :]
        out = [(item, name)]
        if self.seen % self.retry == 0:
            tried = [(o, self._join(o[1], o[2])) for o in self.outliers]
            self.outliers = [o for o, c in tried if c < 0]
            out += [(o[0], c) for o, c in tried if c >= 0]
        if self.seen % self.snapshot == 0:
            self.snapshots = [*self.snapshots, (self.seen, len(self.clusters), sum(c[0] for c in self.clusters.values()))][-self.keep :]
        return out


class MicroClusterProcessor(StatefulProcessor):
    """Micro-clusters of a shard in a map, its outliers and snapshots in lists, its count in a value."""

    def __init__(self, settings: tuple):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "cluster long", "n long, mean array<double>, sse double, last long")
        self.outliers = handle.getListState("outliers", "id long, vector array<double>, at long")
        self.snapshots = handle.getListState("snapshots", "seen long, clusters long, items long")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        model = MicroClusters(*self.settings)
        model.clusters = {name: [n, list(mean), sse, last] for (name,), (n, mean, sse, last) in self.clusters.iterator()}
        model.outliers = [(i, list(v), at) for i, v, at in self.outliers.get()] if self.outliers.exists() else []
        model.snapshots = [tuple(s) for s in self.snapshots.get()] if self.snapshots.exists() else []
        model.seen = self.seen.get()[0] if self.seen.exists() else 0
        batch, out = pd.concat(list(rows)).sort_values(["at", "id"]), []
        for item, vector, at in zip(batch["id"], batch["vector"], batch["at"], strict=True):
            out += model.add(int(item), [float(x) for x in vector], int(at.value // 1_000_000))
        for name, c in model.clusters.items():
            self.clusters.updateValue((name,), tuple(c))
        for state, held in ((self.outliers, model.outliers), (self.snapshots, model.snapshots)):
            state.put(held) if held else state.clear()
        self.seen.update((model.seen,))
        yield pd.DataFrame([(int(key[0]), i, c, model.seen, len(model.snapshots)) for i, c in out], columns=["shard", "id", "cluster", "seen", "snapshots"])


def micro_clusters(items: DataFrame, shards: int = 8, epsilon: float = 0.3, most: int = 100, retry: int = 50, snapshot: int = 1000, keep: int = 100) -> DataFrame:
    """Stream of (shard, id, cluster, seen, snapshots) of items (id, vector, at); cluster -1 waits, and comes again when a retry assigns it."""
    use_state_store(items.sparkSession)
    processor = MicroClusterProcessor((epsilon, most, retry, snapshot, keep))
    return sharded(items, shards).groupBy("shard").transformWithStateInPandas(processor, "shard long, id long, cluster long, seen long, snapshots long", "append", "none")


# Alerts ---------------------------------------------------------------------------------------------


class AlertProcessor(StatefulProcessor):
    """A narrative's last priority and when it was seen; both end after a time of silence, by the rows' own clock."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "priority string, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen = self.last.get() if self.last.exists() else (None, 0)
        kept = []
        for row in pd.concat(list(rows)).sort_values("at").itertuples(index=False):
            at = int(row.at.value // 1_000_000)
            if row.priority != last or at - seen >= self.quiet_ms:
                kept.append((key[0], row.priority, row.at))
            last, seen = row.priority, max(at, seen)
        self.last.update((last, seen))
        self.handle.registerTimer(seen + self.quiet_ms)
        yield pd.DataFrame(kept, columns=["narrative_id", "priority", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[1] + self.quiet_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"narrative_id": pd.Series(dtype="int64"), "priority": pd.Series(dtype="object"), "at": pd.Series(dtype="datetime64[ns]")})


def threshold_alerts(scores: DataFrame, thresholds: DataFrame, quiet: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Alerts (narrative_id, priority, at) of a stream of scores (narrative_id, at, and a column for each dimension).

    Each micro-batch is joined with the thresholds (dimension, limit) as they are then; priority is low, medium or high
    where one, two or three and more are exceeded. An alert that repeats a narrative's last priority is kept back.
    """
    use_state_store(scores.sparkSession)
    dimensions = [c for c in scores.columns if c not in ("narrative_id", "at")]
    limits = thresholds.groupBy().pivot("dimension", dimensions).agg(F.min("limit"))  # one row
    limits = limits.select(*(F.col(d).alias(f"limit_{d}") for d in dimensions))
    over = sum((F.when(F.col(d) > F.col(f"limit_{d}"), 1).otherwise(0) for d in dimensions), F.lit(0))
    rows = scores.withWatermark("at", late).join(F.broadcast(limits)).withColumn("n", over).filter("n > 0")
    priority = F.when(F.col("n") >= 3, "high").when(F.col("n") == 2, "medium").otherwise("low")
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    return rows.select("narrative_id", priority.alias("priority"), "at").groupBy("narrative_id").transformWithStateInPandas(AlertProcessor(quiet_ms), "narrative_id long, priority string, at timestamp", "append", "eventtime")
