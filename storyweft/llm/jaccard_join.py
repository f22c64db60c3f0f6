"""Exact n-gram Jaccard self-join by a token-group matrix.

A text's set holds its distinct five-word shingles, as 64-bit hashes (two different shingles share
one by chance only, about once in 10 ** 19 pairs). Sets link when their Jaccard
similarity reaches ``PERCENT`` %. The join answers with components; it finds every link between
different sets without listing the pairs.

1. Every text is measured: set size, and a set key (equal sets are one node from here on); shingles
   that make up more than ``HOT_SHARE`` of all are listed, at most ``1 / HOT_SHARE`` of them.
2. Shingles go, in blocks, to buckets by hash, where their document frequency is counted. A set whose
   overlap with *any* other can reach the threshold has that share of its shingles in other sets, too;
   all other sets are done. Those that remain are few.
3. Remaining sets are partitioned into groups of similar ones, by a min-hash over the shingles of the
   frequency that most of a set's shingles have. The matrix holds a row for each token of a group's
   token union; for two sets to link, the rarest ``size - needed + 1`` tokens of both must meet, so
   the union is kept over these. Group pairs without a common token, or whose sizes lie too far
   apart, are never opened.
4. Qualifying pairs of groups are opened in cells of bounded size: sets whose overlap with the other
   side's token union is too small are left out, the overlaps of all others counted exactly. A cell
   returns a spanning forest of its links.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing;
a text of fewer words than a shingle is one shingle; repeated rows and equal texts share a component;
a row without id keeps its size and has no component; no rows give no rows. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.components import components
from storyweft.llm.storage import stored
from storyweft.llm.words import SHINGLE_WORDS, mix, shingle_sets, split_by_bytes

PERCENT = 75
#: A shingle is hot when it makes up more than this share of all; hot ones come last in every set's order.
HOT_SHARE = 1e-6
#: Shingles held between flushes; a task reports what it has met at least so often, by a table of so many counters.
FLUSH, REPORT, COUNTERS = 1_000_000, 16, 1 << 21
#: Shingles that one bucket is to hold; sets of one group that one side of a cell holds; groups of one token that meet in a task.
BUCKET, CELL, MEETING = 3_000_000, 768, 64
HOT_CLASS = 63

_U8, _U64 = np.uint8, np.uint64


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any linked set: overlap / union >= t means overlap >= t * size."""
    return -(-size * percent // 100)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, hashes, offsets) of slices of the input."""
    for whole in batches:
        for batch in split_by_bytes(whole, 1, 3_000_000):
            yield batch.column(0), *shingle_sets(batch.column(1))


def _set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A key of each row's set that doesn't depend on the order of its members."""
    total = np.concatenate((np.zeros(1, _U64), np.cumsum(mix(hashes ^ _U64(0x5851F42D4C957F2D)), dtype=_U64)))
    size = np.diff(offsets).astype(_U64)
    return mix(total[offsets[1:]] - total[offsets[:-1]] + size * _U64(0x14057B7EF767814F))


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: (id, n, key) of each text, and (null, count, token) of shingles that are frequent in a task.

    A task counts shingles by their low bits, over all that it reads; one whose counter has reached
    ``REPORT`` is reported with each flush. So a shingle that is never reported occurs in fewer than
    ``REPORT`` sets of every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counters = np.zeros(COUNTERS, np.uint32)

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, _U64), np.zeros(0, int))
            held.clear()
            at = (tokens & _U64(COUNTERS - 1)).astype(np.int64)
            before = counters[at]
            np.add.at(counters, at, counts.astype(np.uint32))
            after = counters[at]
            keep = after >= REPORT
            counts = np.where(before < REPORT, after, counts)[keep]  # the first report brings what came before
            return pa.RecordBatch.from_arrays([pa.array([False] * counts.size, pa.bool_()), pa.nulls(counts.size, pa.int64()), pa.array(counts, pa.int64()), pa.array(_signed(tokens[keep]))], ["is_text", "id", "n", "key"])

        for ids, hashes, offsets in _texts(batches):
            held.append(hashes)
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(ids)), ids.cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(_signed(_set_keys(hashes, offsets)))], ["is_text", "id", "n", "key"])
            if sum(h.size for h in held) > FLUSH:
                yield frequent()
        yield frequent()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "is_text boolean, id long, n long, key long")


def _blocks(to: np.ndarray, sets: np.ndarray, tokens: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    """One row per destination: its entries as packed arrays, in the order of sets."""
    order = np.lexsort((sets, to))
    to, sets, tokens, classes = to[order], sets[order], tokens[order], classes[order]
    cuts = np.concatenate((np.flatnonzero(np.diff(to, prepend=-1)), [to.size])) if to.size else np.zeros(1, int)
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.flatnonzero(np.concatenate(([True], sets[a + 1 : b] != sets[a : b - 1])))
        rows[0].append(int(to[a]))
        rows[1].append(sets[a:b][first].tobytes())
        rows[2].append(np.diff(np.append(first, b - a)).astype(np.uint32).tobytes())
        rows[3].append(tokens[a:b].tobytes())
        rows[4].append(classes[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["to", "sets", "counts", "tokens", "classes"])


_BLOCK = "to long, sets binary, counts binary, tokens binary, classes binary"


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sets, tokens, classes) of all blocks of a table."""

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    return np.repeat(joined("sets", _U64), joined("counts", np.uint32)), joined("tokens", _U64), joined("classes", _U8)


def scatter(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of all sets' shingles, by bucket of the shingle; hot ones travel by set, as they aren't counted."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            sets = np.concatenate([h[0] for h in held])
            tokens = np.concatenate([h[1] for h in held])
            held.clear()
            known = shared.value
            at = np.minimum(np.searchsorted(known, tokens), max(known.size - 1, 0))
            is_hot = known[at] == tokens if known.size else np.zeros(tokens.size, bool)
            to = np.where(is_hot, sets, tokens) % _U64(buckets)
            return _blocks(to.astype(np.int64), sets, tokens, np.where(is_hot, HOT_CLASS, 0).astype(_U8))

        for _, hashes, offsets in _texts(batches):
            keys, size = _set_keys(hashes, offsets), np.diff(offsets)
            _, first = np.unique(keys, return_index=True)  # equal sets of a slice travel once
            once = np.zeros(keys.size, bool)
            once[first] = True
            chosen = np.repeat(once, size)
            held.append((np.repeat(keys, size)[chosen], hashes[chosen]))
            if sum(h[0].size for h in held) > FLUSH:
                yield flushed()
        if held:
            yield flushed()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK)


def count_frequencies(blocks: DataFrame, groups: int) -> DataFrame:
    """Blocks of the shingles that several sets share, with their frequency class, by group of the set."""

    def run(table: pa.Table) -> pa.Table:
        sets, tokens, classes = _entries(table)
        order = np.lexsort((sets, tokens))
        sets, tokens, classes = sets[order], tokens[order], classes[order]
        once = np.ones(sets.size, bool)
        once[1:] = (sets[1:] != sets[:-1]) | (tokens[1:] != tokens[:-1])
        sets, tokens, classes = sets[once], tokens[once], classes[once]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if tokens.size else np.zeros(0, int)
        frequency = np.diff(np.append(starts, tokens.size))
        own = np.repeat(frequency, frequency)
        keep = (own > 1) | (classes == HOT_CLASS)
        log = np.minimum(np.log2(np.maximum(own, 1)), HOT_CLASS - 1).astype(_U8)
        classes = np.where(classes == HOT_CLASS, HOT_CLASS, log).astype(_U8)
        to = (sets >> _U64(20)) % _U64(groups)
        return pa.Table.from_batches([_blocks(to[keep].astype(np.int64), sets[keep], tokens[keep], classes[keep])])

    return blocks.groupBy("to").applyInArrow(run, _BLOCK)


def able_sets(shared: DataFrame, sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """Sets that may link at all: key, n, group, prefix (length) and tokens, the rarest first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, tokens, classes = _entries(left)
        order = np.lexsort((tokens, classes, keys))
        keys, tokens, classes = keys[order], tokens[order], classes[order]
        once = np.ones(keys.size, bool)
        once[1:] = (keys[1:] != keys[:-1]) | (tokens[1:] != tokens[:-1])
        keys, tokens, classes = keys[once], tokens[once], classes[once]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.zeros(0, int)
        count = np.diff(np.append(starts, keys.size))
        known = right.column("key").to_numpy().view(_U64)
        sizes = right.column("n").to_numpy()
        by = np.argsort(known)
        known, sizes = known[by], sizes[by]
        n = sizes[np.searchsorted(known, keys[starts])] if starts.size else np.zeros(0, np.int64)
        least = needed(n, percent)
        rows: list[list] = [[], [], [], [], []]
        for k in np.flatnonzero(count >= least):
            a, b = starts[k], starts[k] + count[k]
            own = tokens[a:b]
            usual = own[classes[a:b] == np.bincount(classes[a:b]).argmax()]
            rows[0].append(int(keys[a : a + 1].view(np.int64)[0]))
            rows[1].append(int(n[k]))
            rows[2].append(int(_signed(usual[mix(usual ^ _U64(0xA0761D6478BD642F)).argmin()][None])[0]))
            rows[3].append(int(count[k] - least[k] + 1))
            rows[4].append(own.tobytes())
        return pa.table({"key": pa.array(rows[0], pa.int64()), "n": pa.array(rows[1], pa.int64()), "group": pa.array(rows[2], pa.int64()), "prefix": pa.array(rows[3], pa.int64()), "tokens": pa.array(rows[4], pa.binary())})

    right = sets.select("key", "n", F.pmod(F.shiftrightunsigned("key", 20), F.lit(groups)).alias("to"))
    return shared.groupBy("to").cogroup(right.groupBy("to")).applyInArrow(run, "key long, n long, group long, prefix long, tokens binary")


def matrix(able: DataFrame) -> DataFrame:
    """The token-group matrix: distinct (token, group) over the sets' rarest tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(1).to_pylist()
            tokens = [np.frombuffer(t, np.int64)[:p] for t, p in zip(batch.column(2).to_pylist(), prefix, strict=True)]
            groups = np.repeat(batch.column(0).to_numpy(), [t.size for t in tokens])
            pairs = np.unique(np.stack((np.concatenate(tokens), groups)), axis=1) if tokens else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["token", "group"])

    return able.select("group", "prefix", "tokens").mapInArrow(run, "token long, group long").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of overlap sizes of two lists of token sets."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left)), [x.size for x in left]), np.repeat(np.arange(len(right)), [x.size for x in right])
    common = np.intersect1d(a, b)
    counts = np.zeros((len(left), len(right)), np.float32)

    def coded(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, tokens), max(common.size - 1, 0))
        hit = common[at] == tokens if common.size else np.zeros(tokens.size, bool)
        return at[hit], rows[hit]

    code_a, row_a = coded(a, row_a)
    code_b, row_b = coded(b, row_b)
    for first in range(0, common.size, 4096):
        width = min(4096, common.size - first)
        here_a, here_b = (code_a >= first) & (code_a < first + width), (code_b >= first) & (code_b < first + width)
        rows, rows_at = np.unique(row_a[here_a], return_inverse=True)
        columns, columns_at = np.unique(row_b[here_b], return_inverse=True)
        m = np.zeros((rows.size, width), np.float32)
        m[rows_at, code_a[here_a] - first] = 1
        k = np.zeros((columns.size, width), np.float32)
        k[columns_at, code_b[here_b] - first] = 1
        counts[np.ix_(rows, columns)] += m @ k.T
    return counts


def _open_cell(table: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the links between the two sides of a cell (or within its only side)."""
    side = table.column("side").to_numpy()
    keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    tokens = [np.frombuffer(t, _U64) for t in table.column("tokens").to_pylist()]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = two.size == 0
    if within:
        two = one
    else:  # bound each set's overlap by the other side's token union
        for _ in range(2):
            if one.size and two.size:
                union = np.unique(np.concatenate([tokens[i] for i in two]))
                one = np.array([i for i in one if np.isin(tokens[i], union, assume_unique=True).sum() >= needed(n[i], percent)], int)
            one, two = two, one
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if one.size and two.size:
        overlap = np.rint(_overlaps([tokens[i] for i in one], [tokens[i] for i in two])).astype(np.int64)
        i, j = np.nonzero(100 * overlap >= percent * (n[one][:, None] + n[two][None, :] - overlap))
        i, j = one[i], two[j]
        if within:
            i, j = i[i < j], j[i < j]
        parent = list(range(len(keys)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kept = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                kept.append((x, y))
        if kept:
            at = np.array(kept)
            a, b = keys[at[:, 0]], keys[at[:, 1]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def meetings(rows: DataFrame, sizes: DataFrame, percent: int, meeting: int = MEETING) -> DataFrame:
    """Distinct pairs of groups (one < two) that share a token and whose sets' sizes can link.

    The groups of one token are dealt to chunks of about ``meeting``; every two chunks meet under a
    key of their own, so no key gathers all groups of a frequent token.
    """
    chunks = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / meeting).alias("chunks"))
    dealt = rows.join(chunks, "token").join(sizes.select("group", "least", "most"), "group").withColumn("own", F.pmod(F.xxhash64("group"), F.col("chunks")))
    facing = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    left = dealt.select("token", F.col("own").alias("i"), facing.alias("j"), F.col("group").alias("one"), F.col("least").alias("least_one"), F.col("most").alias("most_one"))
    right = dealt.select("token", facing.alias("i"), F.col("own").alias("j"), F.col("group").alias("two"), F.col("least").alias("least_two"), F.col("most").alias("most_two"))
    fits = (F.col("most_one") * 100 >= F.col("least_two") * percent) & (F.col("most_two") * 100 >= F.col("least_one") * percent)
    return left.join(right, ["token", "i", "j"]).filter((F.col("one") < F.col("two")) & fits).select("one", "two").distinct()


def links(able: DataFrame, percent: int, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that span the components of the sets' similarity graph."""
    sizes = able.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = stored(sizes, "jaccard-groups")
    rows = stored(matrix(able), "jaccard-matrix")
    met = meetings(rows, sizes, percent)
    one, two = (sizes.select(F.col("group").alias(x), F.ceil(F.col("sets") / cell).alias(f"chunks_{x}")) for x in ("one", "two"))
    across = met.join(one, "one").join(two, "two").select("one", "two", "chunks_one", "chunks_two")
    inner = one.join(sizes.filter("sets > 1").select(F.col("group").alias("one")), "one").select("one", F.col("one").alias("two"), "chunks_one", F.col("chunks_one").alias("chunks_two"))
    pairs = across.unionByName(inner)
    # Each side of a pair in chunks; a chunk meets every chunk of the other side, within a group every later one.
    sides = pairs.select(F.col("one").alias("group"), "one", "two", F.lit(0).alias("side"), F.col("chunks_one").alias("own"), F.col("chunks_two").alias("other"))
    sides = sides.unionByName(pairs.select(F.col("two").alias("group"), "one", "two", F.lit(1).alias("side"), F.col("chunks_two").alias("own"), F.col("chunks_one").alias("other")))
    sides = stored(sides, "jaccard-pairs")
    chunk = F.pmod(F.xxhash64("key"), F.col("own"))
    placed = able.select("key", "n", "group", "tokens").join(sides, "group").withColumn("chunk", chunk).withColumn("facing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    first, last = F.when(F.col("side") == 0, F.col("chunk")).otherwise(F.col("facing")), F.when(F.col("side") == 0, F.col("facing")).otherwise(F.col("chunk"))
    placed = placed.withColumn("i", first).withColumn("j", last)
    # In a group with itself: chunk pairs i < j have both sides, i = j only one.
    placed = placed.filter((F.col("one") != F.col("two")) | (F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("side") == 0)))

    def run(table: pa.Table) -> pa.Table:
        return _open_cell(table, percent)

    return placed.select("one", "two", "i", "j", "side", "key", "n", "tokens").groupBy("one", "two", "i", "j").applyInArrow(run, "a long, b long")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    measured = stored(measure(docs, id_col, text_col), "jaccard-measured")
    texts = measured.filter("is_text").select("id", "n", "key")
    total = texts.agg(F.sum("n")).first()[0] or 0
    listed = measured.filter("not is_text").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > max(REPORT, total * HOT_SHARE)).select("key").toArrow()  # 1 / HOT_SHARE rows at most
    hot = np.sort(listed.column(0).to_numpy().view(_U64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))
    # All rows of a set key have one size; null ids lend it to their set without naming it.
    sets = texts.filter("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"))
    sets = stored(sets, "jaccard-sets")
    shared = count_frequencies(scatter(docs, id_col, text_col, hot, buckets), buckets)
    able = stored(able_sets(shared, sets, buckets, percent), "jaccard-able")
    found = components(stored(links(able, percent), "jaccard-links"))
    # A component's name is the smallest id of its sets.
    named = found.join(sets.select(F.col("key").alias("node"), "least"), "node", "left")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    labels = sets.select("key", "least").join(named.join(names, "component").select(F.col("node").alias("key"), "name"), "key", "left").select("key", F.coalesce("name", "least").alias("component_id"))
    labels = stored(labels, "jaccard-labels")
    joined = texts.join(labels, "key", "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
