"""Clustering features: groups of close vectors as (n, sum, sum of squares), built by a tree in each partition and merged by addition.

A feature absorbs a vector, or another feature, while the radius of all it holds stays within the threshold.
Partitions build their trees apart; features that meet in a cell of a few projections are then merged
by the same rule, in two rounds, so that no task gathers all of them; a cell with more features than a tree holds is merged
in parts. Totals are exact whatever the grouping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions.lineage import cut

#: Entries of a node, features that a tree holds before it is given out, and features given out at once.
BRANCHING, MOST, AT_ONCE = 50, 20_000, 4_096
_FEATURE = "n long, ls array<double>, ss double"


def radius(n: float, ls: np.ndarray, ss: float) -> float:
    """Root mean square distance of a feature's vectors from their mean."""
    mean = ls / n
    return float(np.sqrt(max(0.0, ss / n - float(mean @ mean))))


class Node:
    """A node's entries are features; an inner node's are the sums of its children."""

    def __init__(self, dimensions: int, size: int, leaf: bool):
        self.n, self.ls, self.ss = np.zeros(size + 1), np.zeros((size + 1, dimensions)), np.zeros(size + 1)
        self.children: list[Node] = []
        self.used, self.size, self.leaf = 0, size, leaf

    def append(self, n: float, ls: np.ndarray, ss: float, child: Node | None = None) -> None:
        self.n[self.used], self.ls[self.used], self.ss[self.used] = n, ls, ss
        self.used += 1
        if child is not None:
            self.children.append(child)

    def total(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.used].sum(), self.ls[: self.used].sum(0), self.ss[: self.used].sum()

    def split(self) -> tuple[Node, Node]:
        """Two nodes around the two entries that lie farthest apart."""
        centre = self.ls[: self.used] / self.n[: self.used, None]
        apart = ((centre[:, None] - centre[None]) ** 2).sum(2)
        a, b = np.unravel_index(int(apart.argmax()), apart.shape)
        parts = (Node(centre.shape[1], self.size, self.leaf), Node(centre.shape[1], self.size, self.leaf))
        right = apart[:, b] < apart[:, a]
        right[[a, b]] = False, True
        for k in range(self.used):
            parts[int(right[k])].append(self.n[k], self.ls[k], self.ss[k], None if self.leaf else self.children[k])
        return parts

    def insert(self, n: float, ls: np.ndarray, ss: float, threshold: float) -> tuple[Node, Node] | None:
        """Add a feature; returns this node's halves if it had to be split."""
        if self.used:
            near = int((((self.ls[: self.used] / self.n[: self.used, None]) - ls / n) ** 2).sum(1).argmin())
            if self.leaf:
                if radius(self.n[near] + n, self.ls[near] + ls, self.ss[near] + ss) <= threshold:
                    self.n[near] += n
                    self.ls[near] += ls
                    self.ss[near] += ss
                    return None
            else:
                halves = self.children[near].insert(n, ls, ss, threshold)
                if halves is None:
                    self.n[near], self.ls[near], self.ss[near] = self.children[near].total()
                    return None
                self.children[near] = halves[0]
                self.n[near], self.ls[near], self.ss[near] = halves[0].total()
                self.append(*halves[1].total(), halves[1])
                return self.split() if self.used > self.size else None
        self.append(n, ls, ss)
        return self.split() if self.used > self.size else None

    def features(self) -> Iterator[tuple[int, list[float], float]]:
        for k in range(self.used):
            if self.leaf:
                yield int(self.n[k]), self.ls[k].tolist(), float(self.ss[k])
            else:
                yield from self.children[k].features()


class Tree:
    """A tree of features within a threshold."""

    def __init__(self, threshold: float, branching: int = BRANCHING):
        self.threshold, self.branching, self.root, self.added = threshold, branching, None, 0

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        if self.root is None:
            self.root = Node(ls.size, self.branching, True)
        halves = self.root.insert(n, ls, ss, self.threshold)
        if halves:
            self.root = Node(ls.size, self.branching, False)
            for half in halves:
                self.root.append(*half.total(), half)
        self.added += 1

    def drained(self) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"n": [], "ls": [], "ss": []}), *self.parts()])

    def parts(self) -> Iterator[pd.DataFrame]:
        rows = self.root.features() if self.root else iter(())
        self.root, self.added = None, 0
        while part := list(islice(rows, AT_ONCE)):
            yield pd.DataFrame(part, columns=["n", "ls", "ss"])


def sound(rows: DataFrame) -> DataFrame:
    """Rows whose vector (as doubles) has components, all of them finite: a mean with any other is no point."""
    whole = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    return whole.filter((F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def clustering_features(rows: DataFrame, threshold: float = 0.5, branching: int = BRANCHING, cells: int = 4, seed: int = 42, most: int = MOST) -> DataFrame:
    """Features (n, ls, ss, radius) of all rows' vectors, each within the threshold. Rows without vector, or with components that are null or not finite, take no part; all vectors have one length."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(threshold, branching)
        for batch in batches:
            for vector in batch["vector"]:
                v = np.asarray(vector, float)
                tree.add(1, v, float(v @ v))
                if tree.added >= most:
                    yield from tree.parts()
        yield from tree.parts()

    def merge(features: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(threshold, branching)
        for n, ls, ss in features.sort_values("n", ascending=False)[["n", "ls", "ss"]].itertuples(index=False):
            tree.add(n, np.asarray(ls, float), ss)
        return tree.drained()

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                centre = np.stack(batch["ls"].to_numpy()) / batch["n"].to_numpy()[:, None]
                direction = np.random.default_rng(seed).normal(size=(centre.shape[1], cells)) / np.sqrt(centre.shape[1])
                batch = batch.assign(cell=[",".join(map(str, c)) for c in np.floor(centre @ direction / (4 * threshold)).astype(int)])
                yield batch[["n", "ls", "ss", "cell"]]

    built = sound(rows).select("vector").mapInPandas(build, _FEATURE)
    def met(features: DataFrame, part: Column) -> DataFrame:
        placed = cut(features.mapInPandas(celled, f"{_FEATURE}, cell string").withColumn("part", part))
        parts = placed.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
        dealt = placed.join(parts, ["cell", "part"]).withColumn("of", F.pmod(F.xxhash64("ls"), F.col("parts")))
        return dealt.groupBy("cell", "part", "of").applyInPandas(merge, _FEATURE)

    merged = met(met(built, F.spark_partition_id() % 64), F.lit(0))
    mean2 = F.aggregate("ls", F.lit(0.0), lambda s, x: s + x * x) / (F.col("n") * F.col("n"))
    return merged.withColumn("radius", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean2)))


def birch(rows: DataFrame, features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster): k-means over the features' means, weighted by their sizes, gives the centres that rows are assigned to."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    means = cut(features.select(F.transform("ls", lambda x: x / F.col("n")).alias("mean"), F.col("n").cast("double").alias("weight")))
    own = sound(rows).select("id", array_to_vector("vector").alias("features"))
    if means.select("mean").distinct().limit(2).count() < 2:  # k-means needs two points
        return own.select("id", F.lit(0).alias("cluster"))
    model = KMeans(k=k, seed=seed, weightCol="weight").fit(means.select(array_to_vector("mean").alias("features"), "weight"))
    return model.transform(own).select("id", F.col("prediction").alias("cluster"))
