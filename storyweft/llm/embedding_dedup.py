"""Near-duplicate embeddings: spherical k-means cells, blocked cosines, one representative a group.

Only vectors with the same label are compared. Equal vectors are one node that counts as often as
it comes. For each label a spherical k-means on a bounded sample gives centroids; a vector's home
is the cell of the nearest. A linked pair may lie on both sides of a border, so a vector is also a
guest in every cell whose border is no farther than the threshold's angle, which loses no pair: if
x is at home in a, y in b and their angle is at most t, then y's distance to the plane between the
two centroids, ``(y.b - y.a) / |b - a|``, is at most sin t.

A cell's vectors are cut into chunks and compared chunk by chunk, so a cell that holds a third of
all vectors is many small tasks. A task returns a link count for each home vector and a spanning
forest of the links, never the pairs.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, or has
no label, links with nothing and is kept; vectors of different lengths never link; rows that repeat an
id and vector count as several; an empty table gives no rows. Only the three columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from storyweft.llm.components import components
from storyweft.llm.hilbert import _units, usable
from storyweft.llm.storage import stored

THRESHOLD = 0.98
#: Vectors that a cell is to hold; bound of the sample that centroids are fitted on; k-means rounds.
CELL, SAMPLE, ROUNDS = 2048, 50_000, 8
#: Vectors of one side of a task.
CHUNK = 1024


def _fit(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means; the first ones are spread over the sample in its order."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        home = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centroids)
    return centroids


def fit_cells(nodes: DataFrame, total: int, cell: int = CELL, sample: int = SAMPLE) -> dict[tuple[int, int], np.ndarray]:
    """Centroids by (label, vector length); at most one for each eight vectors of the bounded sample."""
    share = min(1.0, sample / max(total, 1))
    drawn = nodes.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("dim", F.size("vector"))

    def run(table: pa.Table) -> pa.Table:
        rows, norms = _units(table.column("vector"))
        k = max(1, min(round(len(rows) / share / cell), len(rows) // 8))
        order = np.lexsort(rows.T[::-1])
        found = _fit((rows / norms[:, None])[order], k)
        return pa.table({"label": pa.array([table.column("label")[0].as_py()] * k, pa.int64()), "dim": pa.array([rows.shape[1]] * k, pa.int32()), "centroid": pa.array(list(found), pa.list_(pa.float64()))})

    fitted = drawn.select("label", "dim", "vector").groupBy("label", "dim").applyInArrow(run, "label long, dim int, centroid array<double>")
    out: dict[tuple[int, int], list] = {}
    for row in fitted.collect():
        out.setdefault((row["label"], row["dim"]), []).append(row["centroid"])
    return {key: np.array(rows) for key, rows in out.items()}


def assign(nodes: DataFrame, cells: dict[tuple[int, int], np.ndarray], threshold: float) -> DataFrame:
    """Each vector at home in its cell and as a guest where a linked one may be at home."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)  # bounded by the sample
    sine = float(np.sqrt(1 - threshold**2)) + 1e-9
    single = nodes.schema["vector"].dataType.elementType.simpleString() == "float"  # else all digits are kept
    kind = pa.list_(pa.float32() if single else pa.float64())
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("guest", pa.bool_()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", kind)])

    def run(batches):
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(), np.asarray(batch.column("vector").value_lengths())
            for label, dim in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
                own = batch.filter(pa.array((labels == label) & (dims == dim)))
                rows, norms = _units(own.column("vector"))
                centroids = shared.value.get((label, dim))
                at, cell = np.arange(len(rows)), np.zeros(len(rows), int)
                guest = np.zeros(len(rows), bool)
                if centroids is not None and len(centroids) > 1:
                    dots = (rows / norms[:, None]) @ centroids.T
                    home = dots.argmax(axis=1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
                    near = dots[at, home][:, None] - dots <= sine * apart[home] + 1e-9
                    near[at, home] = True
                    at, cell = np.nonzero(near)
                    guest = cell != home[at]
                part = own.take(pa.array(at))
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, label), pa.int64()), pa.array(np.full(n, dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(guest), part.column("node"), part.column("copies"), part.column("vector").cast(kind)], schema=schema)

    return nodes.select("label", "node", "copies", "vector").mapInArrow(run, f"label long, dim int, cell int, guest boolean, node long, copies long, vector array<{'float' if single else 'double'}>")


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts (node, links) of the left side, and forest edges (node, other)."""
    side = table.column("side").to_numpy()
    left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    nodes, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        (a, na), (b, nb) = _units(left.column("vector")), _units(right.column("vector"))
        ids, others, copies = left.column("node").to_numpy(), right.column("node").to_numpy(), right.column("copies").to_numpy()
        linked = (a @ b.T) / (na[:, None] * nb[None, :]) >= threshold
        linked &= ids[:, None] != others[None, :]
        count = linked @ copies
        some = count > 0
        nodes.append(ids[some])
        links.append(count[some])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in np.flatnonzero(some):
            x = int(ids[i])
            for y in others[linked[i]].tolist():
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    ends.append((x, y))
    n = sum(map(len, nodes))
    return pa.table({
        "node": pa.array(np.concatenate([*nodes, np.array([e[0] for e in ends], np.int64)])),
        "links": pa.array([*np.concatenate(links).tolist(), *[None] * len(ends)], pa.int64()),
        "other": pa.array([*[None] * n, *[e[1] for e in ends]], pa.int64()),
    })


def _code(vectors: DataFrame, label_col: str) -> Column:
    """A number for each label: an integer as it is, any other by its 64-bit hash; null stays null."""
    label = F.col(label_col)
    return label.cast("long") if isinstance(vectors.schema[label_col].dataType, IntegralType) else F.when(label.isNotNull(), F.xxhash64(label))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, cell: int = CELL, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """One row per row: id, n_links, component_id, kept (the one with the component's smallest id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), _code(vectors, label_col).alias("label"))
    able = usable(F.col("vector")) & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(able, F.xxhash64("label", "vector")))
    nodes = rows.filter("node is not null").groupBy("node", "label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "embedding-nodes")
    placed = stored(assign(nodes, fit_cells(nodes, nodes.count(), cell, sample), threshold), "embedding-cells")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count_if(~F.col("guest")) / chunk).alias("lefts"), F.ceil(F.count(F.lit(1)) / chunk).alias("rights"))
    members = placed.join(stored(sizes, "embedding-sizes"), key)
    left = members.filter("not guest").select(*key, "node", "copies", "vector", F.lit(0).alias("side"), F.pmod(F.xxhash64("node"), F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"))
    right = members.filter("lefts > 0").select(*key, "node", "copies", "vector", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("rights")).alias("j"))

    def run(table: pa.Table) -> pa.Table:
        return _compare(table, threshold)

    found = stored(left.unionByName(right).groupBy(*key, "i", "j").applyInArrow(run, "node long, links long, other long"), "embedding-links")
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = joined.join(nodes.select("node", "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    facts = nodes.select("node", "least", "copies").join(counts, "node", "left").join(named.join(names, "component").select("node", "name"), "node", "left")
    facts = stored(facts.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id")), "embedding-facts")
    out = rows.select("id", "node").join(facts, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
