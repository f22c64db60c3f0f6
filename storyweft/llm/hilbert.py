"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected on a few random directions, shifted, and ordered along a Hilbert curve;
several such orderings differ in directions and shift. Spark range-partitions each ordering, and
counts per partition turn places into global ranks. A query looks at the ``reach`` share of all
vectors on either side of its rank in every ordering; what the windows hold is compared in double
precision, and the windows' best are merged.

Orderings are cut into blocks of a fixed number of ranks. A query visits the blocks that its window
meets, as one row for each; a block's visitors are dealt to tasks of bounded size, each of which has
the block and compares it with a few visitors at a time, so a task's memory doesn't grow with the
table. Equal vectors are one point of the index that keeps its smallest ids, so a vector of which
there are many copies fills no window, and all queries with one vector are one search.

Many curves with narrow windows find more than few with wide ones. With the defaults a query among n
vectors is compared with at most ``2 * CURVES * (REACH * n + MARGIN + k + 1)`` of all orderings together: 0.86 n
and some 1800. So below about 13,000 vectors it may meet each more than once, and at any size a share of
all, which vectors without structure need, as no projection keeps their neighbours together; on
vectors that cluster a far smaller reach is enough.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components takes no
part, nor does a row without id; vectors of another length than a query's are no candidates; equal
scores go by id; rows that repeat a query's id and vector are one query; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.llm.storage import stored

CURVES = 24
#: Share of all points that a query looks at on either side of its place in an ordering, and points besides.
REACH, MARGIN = 0.018, 32
DIRECTIONS, BITS = 6, 10
#: Points of a block; visitors of a task; visitors compared at a time.
BLOCK, VISITORS, SLICE = 4096, 4096, 256
SEED = 11


def usable(vector: Column) -> Column:
    """Whether a vector can be compared."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points on a grid of 2 ** bits cells a side (rows are points).

    From the coarsest bit to the finest, each axis either flips the finer bits of the first axis or
    swaps them with its own; Gray coding then gives the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        finer = (1 << shift) - 1
        for axis in range(dims):
            flip = (x[axis] >> shift & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & finer)
            x[0] ^= np.where(flip, finer, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    carry = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, 0, -1):
        carry ^= np.where(x[-1] >> shift & 1, (1 << shift) - 1, 0)
    x ^= carry
    out = np.zeros(x.shape[1], np.int64)
    for shift in range(bits - 1, -1, -1):
        for axis in range(dims):
            out = out << 1 | (x[axis] >> shift & 1)
    return out


def keys_on_curve(unit: np.ndarray, curve: int, seed: int = SEED) -> np.ndarray:
    """Hilbert key of unit vectors in one ordering."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, curve, dim])
    directions = np.linalg.qr(rng.normal(size=(dim, min(DIRECTIONS, dim))))[0]
    at = unit @ directions * np.sqrt(dim) + rng.uniform(-0.5, 0.5, directions.shape[1])
    grid = np.clip((at + 4) / 8, 0, 1 - 1e-12) * (1 << BITS)
    return curve_index(grid.astype(np.int64), BITS)


def _units(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, norms) in double precision of a column of equally long vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return rows, np.sqrt((rows * rows).sum(axis=1))


def points(vectors: DataFrame, id_col: str, vector_col: str, kept_ids: int) -> DataFrame:
    """Distinct usable vectors: point (their smallest id), vector, ids (the ``kept_ids`` smallest)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= kept_ids)
    return first.groupBy("vector").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))


def order_points(pts: DataFrame, curves: int) -> DataFrame:
    """(curve, rank, point, vector): the points in each ordering, ranked from 0 in it."""

    def keyed(batches):
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.asarray(vectors.value_lengths())
            for n in np.unique(lengths):
                own = batch.filter(pa.array(lengths == n))
                rows, norms = _units(own.column("vector"))
                for curve in range(curves):
                    key = keys_on_curve(rows / norms[:, None], curve)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve), pa.int32()), pa.array(key), own.column("point")], ["curve", "key", "point"])

    spark = pts.sparkSession
    keys = pts.select("point", "vector").mapInArrow(keyed, "curve int, key long, point long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    # The place within a partition is the low part of this id; the folder keeps it with the row.
    ordered = stored(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "curve-order")
    held = ordered.groupBy("curve", "part").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = held.select("curve", "part", "low", before.alias("before"))  # curves x partitions rows at most
    ranked = ordered.join(F.broadcast(firsts), ["curve", "part"]).select("curve", "point", (F.col("before") + F.col("place") - F.col("low")).alias("rank"))
    return ranked.join(pts.select("point", "vector"), "point")


def _best(scores: np.ndarray, ids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's highest finite scores, all that tie with the last one among them by id."""
    if scores.shape[1] > best:
        least = -np.partition(-scores, best - 1, axis=1)[:, best - 1]
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, at = np.nonzero(scores > -np.inf)
    score = scores[row, at]
    order = np.lexsort((ids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    place = np.arange(row.size) - np.searchsorted(row, row)
    keep = place < best
    return row[keep], ids[at[keep]], score[keep]


def compare(visitors: pa.Table, block: pa.Table, window: int, best: int) -> pa.Table:
    """(asked, point, score): the best of a block for each visitor, within the visitors' windows."""
    out: list[list] = [[], [], []]
    if visitors.num_rows and block.num_rows:
        lengths, others = (np.asarray(c.combine_chunks().value_lengths()) for c in (visitors.column("own_vector"), block.column("vector")))
        for n in np.unique(lengths):
            own, other = visitors.filter(pa.array(lengths == n)), block.filter(pa.array(others == n))
            if not other.num_rows:
                continue
            b, nb = _units(other.column("vector"))
            ranks, ids = other.column("rank").to_numpy(), other.column("point").to_numpy()
            for first in range(0, own.num_rows, SLICE):
                part = own.slice(first, SLICE)
                a, na = _units(part.column("own_vector"))
                score = (a @ b.T) / (na[:, None] * nb[None, :])
                score[np.abs(part.column("own_rank").to_numpy()[:, None] - ranks[None, :]) > window] = -np.inf
                row, point, kept = _best(score, ids, best)
                out[0].append(part.column("asked").to_numpy()[row])
                out[1].append(point)
                out[2].append(kept)
    cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
    return pa.table({"asked": cols[0], "point": cols[1], "score": cols[2]})


def nearest(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, reach: float = REACH, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """(query_id, rank, id, score): for the rows that ``queries`` selects, their k nearest found among all others."""
    pts = stored(points(vectors, id_col, vector_col, k + 1), "curve-points")
    ranked = stored(order_points(pts, curves), "curve-ranks")
    total = pts.count()
    window = k + 1 + MARGIN + int(np.ceil(reach * total))
    asked = vectors.filter(queries).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = stored(asked.join(pts.select("point", "vector"), "vector").select("query_id", F.col("point").alias("asked")), "curve-asked")
    # A query stands where its own point stands; one search for each point.
    placed = asked.select("asked").distinct().join(ranked.select(F.col("point").alias("asked"), "vector", "curve", "rank"), "asked")
    low, high = F.greatest(F.lit(0), F.col("rank") - window), F.least(F.lit(total - 1), F.col("rank") + window)
    visits = placed.select("asked", "vector", "curve", F.col("rank").alias("own_rank"), F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("block"))
    members = ranked.select("point", "vector", "curve", "rank", F.floor(F.col("rank") / block).alias("block"))
    key = ["curve", "block"]
    parts = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / visitors).alias("parts"))
    parts = stored(parts, "curve-visits")
    dealt = visits.join(parts, key).select(F.col("curve").alias("own_curve"), F.col("block").alias("own_block"), F.pmod(F.xxhash64("asked"), F.col("parts")).alias("own_part"), "asked", "own_rank", F.col("vector").alias("own_vector"))
    shown = members.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    best = k + 1  # a query may find its own point

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(left, right, window, best)

    found = dealt.groupBy("own_curve", "own_block", "own_part").cogroup(shown.groupBy(*key, "part")).applyInArrow(run, "asked long, point long, score double")
    found = found.groupBy("asked", "point").agg(F.max("score").alias("score"))
    near = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "point"))
    found = found.withColumn("near", near).filter(F.col("near") <= best)
    found = asked.join(found, "asked").join(pts.select("point", F.explode("ids").alias("id")), "point").filter("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.select("query_id", place.cast("int").alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
