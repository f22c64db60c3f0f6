"""A Merkle manifest of a dataset: one tree per group of rows, and a tree over the groups' roots.

Where a row's leaf stands in its group's tree is its rank among the group's document ids. No leaf is
sorted for that: every task describes the ids it reads by compressed bitmaps (of 65,536 ids each, as a
list of positions or as bits, whichever is smaller), these are merged for each group, and a popcount
directory is laid over them: the ids before each word of 64 bits, in four levels of sixteen bits of the id,
so that no running sum has more than 65,536 rows. A row's rank is its word's base plus the bits below its own.

Leaves then fall into keyed slot arrays: block ``rank // 2187`` of a group, slot ``rank % 2187``. A block is
one row that holds its digests packed, and reduces seven levels of the tree at once; the blocks' roots
are the next tier's nodes, and so on, until each group has one node. Proofs go the other way: a
block needs the siblings above it, not the other blocks. The groups' roots form the top tree alike.

Rows that repeat an id in a group (or have none) share a bit. The merged bitmap keeps how many they
are, and they are numbered by digest, equal ones by stored row number in runs of at most 65,536.

Defined cases: a null field is hashed as ``-``; rows without id precede the others of their group; rows
that repeat an id stand in order of their digests; a null group is a group, the first; a group of one row has
that row's leaf as subroot, one group's subroot is the root; without siblings the proof is the digest of
nothing; an empty table gives no rows. Only the named columns are read, so others' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.llm.storage import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that form their parent.
ARITY = 3
#: Levels that a block reduces, and the leaves it then holds.
LEVELS = 7
BLOCK = ARITY**LEVELS
#: Ids of a bitmap; positions in it take sixteen bits.
SPAN = 1 << 16
#: Positions from which a bitmap is no longer than bits as a list.
_DENSE = SPAN // 16
#: Bitmaps a task holds before it gives them out.
_HELD = 2048

_GROUP = "known boolean, grp string"  # a group's key: whether it has a name, and its name
_PART = pa.schema([("known", pa.bool_()), ("grp", pa.string()), ("numbered", pa.bool_()), ("high", pa.int64()), ("bitmap", pa.binary()), ("repeated", pa.binary())])
_PART_DDL = f"{_GROUP}, numbered boolean, high long, bitmap binary, repeated binary"
_WORD_DDL = f"{_GROUP}, numbered boolean, word long, bits long, before long, repeated array<struct<bit: int, more: long>>, total long"
_BLOCK = pa.schema([("known", pa.bool_()), ("grp", pa.string()), ("block", pa.int64()), ("digest", pa.string()), ("ids", pa.binary()), ("nodes", pa.binary()), ("others", pa.binary())])
_BLOCK_DDL = f"{_GROUP}, block long, digest string, ids binary, nodes binary, others binary"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_DDL = "array<struct<left: string, right: string>>"


def field_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of values: ``-`` for null, else UTF-8 byte count, a colon and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


# Compressed bitmaps ---------------------------------------------------------------------------------


def compress(positions: np.ndarray) -> bytes:
    """A bitmap of distinct ascending positions: two bytes a position, or one bit for each of the span."""
    if positions.size < _DENSE:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def positions(bitmap: bytes) -> np.ndarray:
    """The positions that a compressed bitmap holds."""
    if len(bitmap) < SPAN // 8:
        return np.frombuffer(bitmap, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))


def _counted(bitmap: bytes, repeated: bytes, counts: np.ndarray) -> None:
    """Add a bitmap's ids, and those that repeat, to the counts of a span."""
    counts[positions(bitmap)] += 1
    pairs = np.frombuffer(repeated, "<i8").reshape(-1, 2)
    counts[pairs[:, 0]] += pairs[:, 1]


def _described(held: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """(bitmap, repeated) of ascending positions and their counts; ``repeated`` is pairs of position and how many more than one."""
    more = counts > 1
    return compress(held), np.stack((held[more], counts[more] - 1), 1).astype("<i8").tobytes()


def _partial_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of a task's (known, grp, id) rows, merged as far as memory for ``_HELD`` of them goes."""
    held: dict[tuple, np.ndarray] = {}

    def emptied() -> pa.RecordBatch:
        rows = [(*key, *_described(*np.unique(np.concatenate(lows), return_counts=True))) for key, lows in held.items()]
        held.clear()
        columns = zip(*rows, strict=True) if rows else [()] * len(_PART)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART, strict=True)], schema=_PART)

    waiting = 0
    for batch in batches:
        groups = batch.column(1).dictionary_encode()
        names = groups.dictionary.to_pylist()
        code = groups.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        names.append(None)
        numbered = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        high, low = ids >> 16, ids & (SPAN - 1)
        order = np.lexsort((high, numbered, code))
        code, numbered, high, low = code[order], numbered[order], high[order], low[order]
        change = np.flatnonzero((np.diff(code) != 0) | (np.diff(numbered) != 0) | (np.diff(high) != 0)) + 1
        for own in np.split(np.arange(code.size), change):
            if own.size:
                k = own[0]
                held.setdefault((names[code[k]] is not None, names[code[k]], bool(numbered[k]), int(high[k])), []).append(low[own])
        waiting += code.size
        if len(held) > _HELD or waiting > 1 << 22:
            yield emptied()
            waiting = 0
    yield emptied()


def _merge(table: pa.Table) -> pa.Table:
    counts = np.zeros(SPAN, np.int64)
    for bitmap, repeated in zip(table["bitmap"].to_pylist(), table["repeated"].to_pylist(), strict=True):
        _counted(bitmap, repeated, counts)
    first = [table[name][0].as_py() for name in ("known", "grp", "numbered", "high")]
    held = np.flatnonzero(counts)
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*first, *_described(held, counts[held])], _PART, strict=True)], schema=_PART)


def bitmaps(rows: DataFrame) -> DataFrame:
    """One merged bitmap for each (known, grp, numbered, high) of the (known, grp, id) rows.

    Partial bitmaps are merged in two rounds, so that an id that every task meets gathers at most
    the square root of the partial bitmaps in one task.
    """
    keys = ["known", "grp", "numbered", "high"]
    parts = rows.select("known", "grp", "id").mapInArrow(_partial_bitmaps, _PART_DDL).withColumn("salt", F.spark_partition_id() % 256)
    once = parts.groupBy(*keys, "salt").applyInArrow(lambda table: _merge(table), _PART_DDL)
    return once.groupBy(*keys).applyInArrow(_merge, _PART_DDL)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The popcount directory inside each bitmap: its words of 64 bits that aren't empty."""
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.zeros(SPAN, np.int64)
            _counted(row["bitmap"], row["repeated"], counts)
            held = counts.reshape(-1, 64)
            sums = held.sum(1)
            own = np.flatnonzero(sums)
            bits = np.packbits(held[own] > 0, axis=1, bitorder="little").view("<i8").reshape(-1)
            repeated = [[{"bit": int(b), "more": int(held[w][b] - 1)} for b in np.flatnonzero(held[w] > 1)] if held[w].max() > 1 else [] for w in own]
            n = own.size
            yield pa.RecordBatch.from_pydict(
                {
                    "known": [row["known"]] * n, "grp": pa.array([row["grp"]] * n, pa.string()), "numbered": [row["numbered"]] * n, "word": (row["high"] << 10) + own, "bits": bits,
                    "before": (np.cumsum(sums) - sums)[own], "repeated": pa.array(repeated, pa.list_(pa.struct([("bit", pa.int32()), ("more", pa.int64())]))), "total": pa.array([int(sums.sum())] * n, pa.int64()),
                }
            )


def directory(merged: DataFrame) -> DataFrame:
    """(known, grp, numbered, word, bits, base, repeated): the ids of the group before each word of 64 ids.

    Running sums go over sixteen bits of the id at a time, so none has more than 65,536 rows; ids without number come first.
    """
    words = stored(merged.mapInArrow(_words, _WORD_DDL), "merkle-words")
    group = ["known", "grp"]
    level = stored(words.select(*group, "numbered", F.shiftright("word", 10).alias("high"), "total").distinct(), "merkle-totals")
    base = None
    for _ in range(3):
        above = F.shiftright("high", 16)
        before = Window.partitionBy(*group, "numbered", "above").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
        here = level.withColumn("above", above).withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0)))
        sums = here.groupBy(*group, "numbered", "above").agg(F.sum("total").alias("total"))
        found = here.select(*group, "numbered", "high", "above", "first")
        base = found if base is None else _joined(base, found.select(*group, "numbered", F.col("high").alias("above"), F.col("above").alias("next"), F.col("first").alias("more"))).select(*group, "numbered", "high", F.col("next").alias("above"), (F.col("first") + F.col("more")).alias("first"))
        level = sums.withColumnRenamed("above", "high")
    # What is left is one sum for each sign, and one for rows without id.
    before = Window.partitionBy(*group).orderBy("numbered", "high").rowsBetween(Window.unboundedPreceding, -1)
    top = level.withColumn("more", F.coalesce(F.sum("total").over(before), F.lit(0))).select(*group, "numbered", F.col("high").alias("above"), "more")
    base = _joined(base, top).select(*group, "numbered", "high", (F.col("first") + F.col("more")).alias("first"))
    named = words.withColumn("high", F.shiftright("word", 10))
    return _joined(named, base, "high").select(*group, "numbered", "word", "bits", (F.col("before") + F.col("first")).alias("base"), "repeated")


def _joined(left: DataFrame, right: DataFrame, key: str = "above") -> DataFrame:
    """Join on group, numbered and a key; a null group equals itself (its ``known`` and an empty name stand for it)."""
    names = ["known", "grp", "numbered", key]
    held = right.select(*(F.col(n).alias(f"_{n}") for n in names), *(c for c in right.columns if c not in names))
    on = [F.coalesce(left["grp"], F.lit("")) == F.coalesce(held["_grp"], F.lit(""))] + [left[n] == held[f"_{n}"] for n in names if n != "grp"]
    return left.join(held, on).drop(*(f"_{n}" for n in names))


# Coordinates ----------------------------------------------------------------------------------------


def coordinates(leaves: DataFrame) -> DataFrame:
    """Leaves (known, grp, id, row, leaf, other) with ``at``, their place in their group's tree."""
    words = stored(directory(bitmaps(leaves)), "merkle-directory")
    own = leaves.withColumn("numbered", F.col("id").isNotNull()).withColumn("word", F.shiftright(F.coalesce("id", F.lit(0).cast("long")), 6)).withColumn("bit", F.coalesce("id", F.lit(0).cast("long")).bitwiseAND(F.lit(63)).cast("int"))
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)")))) + F.when(F.size("repeated") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.filter("repeated", lambda r: r["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda n, r: n + r["more"])
    )
    shared = F.exists("repeated", lambda r: r["bit"] == F.col("bit"))
    columns = ["known", "grp", "id", "row", "leaf", "other", (F.col("base") + below).alias("at")]
    alone = _joined(own, words.hint("shuffle_hash"), "word").filter(~shared).select(*columns)
    several = words.filter(F.size("repeated") > 0)
    if several.isEmpty():
        return alone
    return alone.unionByName(_numbered(_joined(own, several, "word").filter(shared).select(*columns)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add to ``at`` the place among the rows of the same id: by digest, then by stored row number.

    Digests are counted by their first four digits, equal ones by runs of consecutive row numbers, so no window holds all rows of an id.
    """
    key = ["known", "grp", "at"]
    held = rows.withColumn("head", F.substring("leaf", 1, 4)).withColumn("run", F.shiftright("row", 16))
    runs = held.groupBy(*key, "head", "leaf", "run").agg(F.count(F.lit(1)).alias("n"))
    leaves = runs.groupBy(*key, "head", "leaf").agg(F.sum("n").alias("n"))
    heads = leaves.groupBy(*key, "head").agg(F.sum("n").alias("n"))

    def before(df: DataFrame, parts: list[str], order: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*parts, order, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name))

    first = before(heads, key, "head", "a")
    second = before(leaves, [*key, "head"], "leaf", "b")
    third = before(runs, [*key, "head", "leaf"], "run", "c")
    places = _same(_same(third, second, [*key, "head", "leaf"]), first, [*key, "head"])
    within = Window.partitionBy(*key, "head", "leaf", "run").orderBy("row")
    numbered = held.withColumn("d", F.row_number().over(within) - 1)
    out = _same(numbered, places, [*key, "head", "leaf", "run"])
    return out.withColumn("at", F.col("at") + F.col("a") + F.col("b") + F.col("c") + F.col("d")).select(*rows.columns)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    held = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.coalesce(left["grp"], F.lit("")) == F.coalesce(held["_grp"], F.lit(""))] + [left[k] == held[f"_{k}"] for k in keys if k != "grp"]
    return left.join(held, on).drop(*(f"_{k}" for k in keys))


# Trees ----------------------------------------------------------------------------------------------


def parents(digests: list[str]) -> list[str]:
    """One level up: the digest of every run of ``ARITY`` nodes, the last of which may be shorter."""
    return [hashlib.sha256("".join(digests[k : k + ARITY]).encode()).hexdigest() for k in range(0, len(digests), ARITY)]


def paths(digests: list[str], levels: int) -> list[list[dict[str, str]]]:
    """For each node of a block, the siblings left and right of its ancestors, level by level to the block's root."""
    out: list[list[dict[str, str]]] = [[] for _ in digests]
    width = 1
    for _ in range(levels):
        for k in range(len(digests)):
            run = k - k % ARITY
            step = {"left": "".join(digests[run:k]), "right": "".join(digests[k + 1 : run + ARITY])}
            for path in out[k * width : (k + 1) * width]:
                path.append(step)
        digests, width = parents(digests), width * ARITY
    return out


def fold(digest: str, path: list[dict[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for step in path:
        digest = hashlib.sha256((step["left"] + digest + step["right"]).encode()).hexdigest()
    return digest


def _packed(digests: list[str | None]) -> bytes:
    """Digests as 32 bytes each; a missing one is empty and takes part as zeros."""
    return bytes.fromhex("".join(d or "0" * 64 for d in digests))


def _unpacked(data: bytes) -> list[str]:
    text = data.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _levels(size: int) -> int:
    """Levels of a tree of so many leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def slot_arrays(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes (known, grp, at, id, digest, other, size): one row each with packed arrays and the digest of its root.

    ``size`` is the number of nodes in the group's tier: a tree that fits into one block stops at its own root, others reduce all levels of the block.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        digests = table["digest"].to_pylist()
        level, size = digests, table["size"][0].as_py()
        for _ in range(_levels(size) if size <= BLOCK else LEVELS):
            level = parents(level)
        ids = table["id"].combine_chunks()
        held = np.stack((ids.is_valid().to_numpy(zero_copy_only=False).astype("<i8"), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")))
        first = [table["known"][0].as_py(), table["grp"][0].as_py(), table["at"][0].as_py() // BLOCK, level[0], held.tobytes(), _packed(digests), _packed(table["other"].to_pylist())]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(first, _BLOCK, strict=True)], schema=_BLOCK)

    keyed = nodes.withColumn("block", F.floor(F.col("at") / F.lit(BLOCK)).cast("long"))
    return stored(keyed.groupBy("known", "grp", "block").applyInArrow(run, _BLOCK_DDL), "merkle-blocks")


@dataclass
class Trees:
    """The tiers of blocks of a forest, lowest first, each with its groups' sizes; the last tier has one block per group."""

    tiers: list[DataFrame]
    sizes: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(known, grp, digest) of every tree."""
        return self.tiers[-1].select("known", "grp", "digest")


def grow(leaves: DataFrame) -> Trees:
    """Reduce leaves (known, grp, at, id, digest, other) tier by tier. A tree that is done stays one node of the further tiers."""
    tiers, sizes = [], []
    nodes = leaves
    while True:
        size = stored(nodes.groupBy("known", "grp").agg(F.count(F.lit(1)).alias("size")), "merkle-sizes")
        blocks = slot_arrays(_same(nodes, size, ["known", "grp"]))
        tiers.append(blocks)
        sizes.append(size)
        if size.filter(F.col("size") > BLOCK).isEmpty():
            return Trees(tiers, sizes)
        nodes = blocks.select("known", "grp", F.col("block").alias("at"), F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("string").alias("other"))


def walk(trees: Trees, above: DataFrame, finish: Callable[[dict, list], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Carry paths down: ``above`` has (known, grp, root, path) for every tree; ``finish`` turns a lowest block and its nodes' paths into rows."""
    paths_schema = pa.schema([("known", pa.bool_()), ("grp", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("path", _PATH)])
    paths_ddl = f"{_GROUP}, block long, subroot string, root string, path {_PATH_DDL}"
    now = _same(above, trees.roots.select("known", "grp", F.col("digest").alias("subroot")), ["known", "grp"]).select("known", "grp", F.lit(0).cast("long").alias("block"), "subroot", "root", "path")
    for k in range(len(trees.tiers) - 1, -1, -1):
        last = k == 0

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            out = schema if last else paths_schema
            for batch in batches:
                for j in range(batch.num_rows):  # a block at a time
                    block = batch.slice(j, 1).to_pylist()[0]
                    digests, size = _unpacked(block["nodes"]), block["size"]
                    own = paths(digests, _levels(size) if size <= BLOCK else LEVELS)
                    if last:
                        rows = finish(block, own)
                    else:
                        rows = [(block["known"], block["grp"], block["block"] * BLOCK + i, block["subroot"], block["root"], p + block["path"]) for i, p in enumerate(own)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        blocks = _same(_same(trees.tiers[k].drop("digest"), trees.sizes[k], ["known", "grp"]), now, ["known", "grp", "block"])
        now = blocks.mapInArrow(run, ddl if last else paths_ddl)
        if not last:
            now = stored(now, "merkle-paths")
    return now


@dataclass
class Manifest:
    """The trees of all groups, the tree over the groups, and each group's place in it."""

    groups: Trees
    top: Trees
    places: DataFrame

    @property
    def root(self) -> str | None:
        """The root of the dataset; None for an empty one."""
        row = self.top.roots.first()
        return row["digest"] if row else None


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. ``tampered`` replaces fields in a second digest of each row, which a proof may be folded with."""
    other = field_digest([(tampered or {}).get(f, F.col(f)) for f in fields])
    leaves = docs.select(
        F.col(group_col).isNotNull().alias("known"), F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        field_digest([F.col(f) for f in fields]).alias("leaf"), (other if tampered else F.lit(None).cast("string")).alias("other"),
    )
    leaves = stored(leaves.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "merkle-leaves")
    groups = grow(coordinates(leaves).withColumnRenamed("leaf", "digest").drop("row"))
    # Groups are put in order by ranges of their names, counted for each range, so that they may be many.
    ranges = stored(groups.roots.repartitionByRange("known", "grp").withColumn("part", F.spark_partition_id()), "merkle-groups")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    firsts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("known", "grp")
    places = ranges.withColumn("k", F.row_number().over(within) - 1).join(firsts, "part").select("known", "grp", (F.col("first") + F.col("k")).cast("long").alias("at"), "digest")
    places = stored(places, "merkle-places")
    # Stored, so that the one group's name is a column to join on like any other's and not a constant.
    one = stored(places.select(F.lit(False).alias("known"), F.lit(None).cast("string").alias("grp"), "at", F.col("at").alias("id"), "digest", F.lit(None).cast("string").alias("other")), "merkle-top")
    return Manifest(groups, grow(one), places)


_PROOF = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("proof", _PATH)])


def proofs(manifest: Manifest, id_col: str = "doc_id", keep_proofs: bool = True) -> DataFrame:
    """One row per row: id, leaf, subroot, root, digest of the proof, the root folded from the tampered (else original) leaf, whether that is the root, and the proof.

    A proof is the siblings left and right of the leaf and its ancestors, level by level.
    """
    schema = _PROOF if keep_proofs else pa.schema(list(_PROOF)[:-1])
    ddl = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {_PATH_DDL}" if keep_proofs else "")

    def placed(block: dict, own: list) -> list[tuple]:
        at = np.frombuffer(block["ids"], "<i8").reshape(2, -1)[1]
        return [(int(k), block["root"], path + block["path"]) for k, path in zip(at, own, strict=True)]

    nothing = manifest.top.roots.select("known", "grp", F.col("digest").alias("root"), F.expr(f"CAST(array() AS {_PATH_DDL})").alias("path"))
    top = walk(manifest.top, nothing, placed, pa.schema([("at", pa.int64()), ("root", pa.string()), ("path", _PATH)]), f"at long, root string, path {_PATH_DDL}")
    above = stored(manifest.places.join(top, "at").select("known", "grp", "root", "path"), "merkle-above")

    def proven(block: dict, own: list) -> list[tuple]:
        valid, ids = np.frombuffer(block["ids"], "<i8").reshape(2, -1)
        rows, missing = [], "0" * 64
        for known, k, leaf, other, path in zip(valid.tolist(), ids.tolist(), _unpacked(block["nodes"]), _unpacked(block["others"]), own, strict=True):
            whole = path + block["path"]
            siblings = "".join(part for step in whole for part in (step["left"], step["right"]))
            folded = fold(leaf if other == missing else other, whole)
            rows.append((k if known else None, leaf, block["subroot"], block["root"], hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == block["root"], whole)[: len(schema)])
        return rows

    return walk(manifest.groups, above, proven, schema, ddl).withColumnRenamed("id", id_col)


def verify(leaf: str, proof: list, root: str) -> bool:
    """Whether a leaf belongs to a dataset, by its proof alone."""
    return fold(leaf, [{"left": step["left"], "right": step["right"]} for step in proof]) == root
