"""Ranked lexical search of many items over all documents by a dual tree, exactly.

A document scores the sum, over an item's terms, of the term's weight times its saturated count in the
document: an inner product of vectors that are never negative. So a node of documents is bounded by its
coordinates' maxima, and so is a node of items; the product of both maxima bounds every pair below the
two nodes. Where that is less than the weakest of the items' k-th best scores so far, no pair below
can enter a result, and the whole batch is left out. All else is scored, by blocks of documents and items.

Items are searched in blocks of bounded number and bytes, each in one pass over the texts. A pass
keeps of every text only the counts of the block's terms, from which Spark sums the corpus statistics;
then every task puts its documents into trees of bounded size, similar ones side by side, walks them with
the tree of items, and gives its k best per item, which are ranked in two rounds. No document or item is
capped, and no pair that could score higher is left out.

Terms are found exactly: separators become spaces, bytes of other characters stay, and the strings
themselves are looked up. All sums are below 2**53, where doubles are exact, or the search refuses.

Defined cases: a null or empty text has no term and never scores; an item without terms, or whose terms
no document holds, returns nothing; rows that repeat an item's id and text are one item, an id with
several texts is ranked for each; rows that repeat a document are ranked each, those without id behind
others of equal score; empty tables give no rows. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.llm.storage import stored
from storyweft.llm.words import split_by_bytes, string_buffers

BEST = 50
#: Items, and bytes of their texts, of a block (a longer text is a block with few others).
BLOCK_ITEMS, BLOCK_BYTES = 512, 4_000_000
#: Items of a leaf, and the documents of a leaf; both at most as many as fill ``LEAF_CELLS`` cells with their terms.
ITEM_LEAF, DOC_LEAF, LEAF_CELLS = 32, 64, 1 << 20
#: Leaves below a node.
FAN = 8
#: Documents, and counts, of a tree.
TREE_DOCS, TREE_COUNTS = 8192, 2_000_000

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: What each byte becomes: lower case, or a space between terms.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20

_COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])
_FOUND = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def plain(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every separator made a space; null becomes empty."""
    raw, offsets = string_buffers(texts)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(_PLAIN[raw])])


def term_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in each text with repeats, row, term, count): the counts of the vocabulary's terms, by row."""
    pieces = pc.split_pattern(plain(texts), " ")
    at = pieces.offsets.to_numpy()
    coded = pieces.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    code = coded.indices.to_numpy()
    words = coded.dictionary
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    known = pc.index_in(words, vocabulary).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    total = np.bincount(row[real[code]], minlength=len(texts)) if code.size else np.zeros(len(texts), np.int64)
    term = known[code] if code.size else np.zeros(0, np.int64)
    own = term >= 0
    key, count = np.unique(row[own].astype(np.int64) * max(len(vocabulary), 1) + term[own], return_counts=True)
    return total, key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), count


# Trees ----------------------------------------------------------------------------------------------


def _leaves(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most``, and fewer where rows times terms would exceed ``LEAF_CELLS``."""
    out, first, terms = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and (k - first >= most or (k - first + 1) * (terms + size) > LEAF_CELLS):
            out.append((first, k))
            first, terms = k, 0
        terms += size
    if sizes.size > first:
        out.append((first, sizes.size))
    return out


def _levels(leaves: int) -> list[list[tuple[int, int]]]:
    """Runs of leaves of the nodes of each level, the root's first, the leaves' last."""
    out = [[(k, k + 1) for k in range(leaves)]]
    while len(out[0]) > 1:
        below = out[0]
        out.insert(0, [(below[k][0], below[min(k + FAN, len(below)) - 1][1]) for k in range(0, len(below), FAN)])
    return out


@dataclass
class Rows:
    """Sparse rows: row k has ``terms[at[k]:at[k + 1]]`` with ``values``."""

    at: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, order: np.ndarray) -> Rows:
        size = np.diff(self.at)[order]
        at = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(at[-1]) + np.repeat(self.at[:-1][order] - at[:-1], size)
        return Rows(at, self.terms[source], self.values[source])

    def maxima(self, bounds: list[tuple[int, int]]) -> Rows:
        """One row for each run of rows: its coordinates' maxima."""
        ends = self.at[[b for _, b in bounds]]
        starts = self.at[[a for a, _ in bounds]]
        node = np.repeat(np.arange(len(bounds)), ends - starts)
        order = np.lexsort((self.terms, node))
        node, term, value = node[order], self.terms[order], self.values[order]
        new = np.ones(node.size, bool)
        new[1:] = (node[1:] != node[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(new)
        value = np.maximum.reduceat(value, first) if first.size else value
        return Rows(np.concatenate(([0], np.cumsum(np.bincount(node[first], minlength=len(bounds))))), term[first], value)

    def by_likeness(self, weight: np.ndarray) -> np.ndarray:
        """An order that puts rows side by side whose heaviest three terms are alike."""
        n = len(self.at) - 1
        row = np.repeat(np.arange(n), np.diff(self.at))
        order = np.lexsort((self.terms, -(self.values * weight[self.terms]), row))
        heaviest = np.full((3, n), -1, np.int64)
        for k in range(3):
            has = np.diff(self.at) > k
            heaviest[k, has] = self.terms[order[self.at[:-1][has] + k]]
        return np.lexsort(heaviest[::-1])


class Items:
    """The tree over a block of items, and their k best documents so far."""

    def __init__(self, rows: Rows, vocabulary: int, best: int):
        self.order = rows.by_likeness(np.ones(vocabulary))
        rows = rows.take(self.order)
        self.leaves = _leaves(np.diff(rows.at), ITEM_LEAF)
        self.levels = _levels(len(self.leaves)) if self.leaves else []
        self.nodes = []  # for each level the dense maxima of its nodes
        for level in self.levels:
            held = rows.maxima([(self.leaves[a][0], self.leaves[b - 1][1]) for a, b in level])
            dense = np.zeros((len(level), vocabulary))
            dense[np.repeat(np.arange(len(level)), np.diff(held.at)), held.terms] = held.values
            self.nodes.append(dense)
        self.blocks = []  # for each leaf: place of each term among its own (or -1), and terms x items
        for a, b in self.leaves:
            own = slice(rows.at[a], rows.at[b])
            terms, place = np.unique(rows.terms[own], return_inverse=True)
            lookup = np.full(vocabulary, -1, np.int32)
            lookup[terms] = np.arange(terms.size)
            block = np.zeros((terms.size, b - a))
            block[place, np.repeat(np.arange(b - a), np.diff(rows.at[a : b + 1]))] = rows.values[own]
            self.blocks.append((lookup, block))
        self.best = best
        n = len(self.order)
        self.least = np.ones(n)  # a score below can't enter; zero never does
        self.held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.waiting = np.zeros(n, np.int64)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Documents that might enter an item's best."""
        self.held[item].append((scores, ids, known))
        self.waiting[item] += scores.size
        if self.waiting[item] >= 4 * self.best or self.waiting[item] >= self.best > 0 and self.least[item] <= 1:
            self.settle(item)

    def settle(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep the best, and raise what a score must reach."""
        if not self.held[item]:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        scores, ids, known = (np.concatenate(part) for part in zip(*self.held[item], strict=True))
        order = np.lexsort((ids, ~known, -scores))[: self.best]
        kept = scores[order], ids[order], known[order]
        self.held[item], self.waiting[item] = [kept], order.size
        if order.size == self.best:
            self.least[item] = max(1.0, kept[0][-1])
        return kept


def search(items: Items, docs: Rows, ids: np.ndarray, known: np.ndarray, weight: np.ndarray) -> int:
    """Walk a tree of documents with that of the items; returns the number of pairs of leaves that were scored."""
    order = docs.by_likeness(weight)
    docs, ids, known = docs.take(order), ids[order], known[order]
    leaves = _leaves(np.diff(docs.at), DOC_LEAF)
    if not leaves or not items.levels:
        return 0
    levels = _levels(len(leaves))
    maxima = {len(levels) - 1: docs.maxima(leaves)}
    for k in range(len(levels) - 2, -1, -1):
        below, child = maxima[k + 1], len(levels[k + 1])
        maxima[k] = below.maxima([(j, min(j + FAN, child)) for j in range(0, child, FAN)])
    # Pairs (document node, item node) that may hold a result, level by level; the lower tree waits at its leaves.
    pairs = {0: np.arange(len(levels[0]))}
    d = i = 0
    while True:
        bounds: dict[int, np.ndarray] = {}
        kept: dict[int, np.ndarray] = {}
        for node, own in pairs.items():
            a, b = items.levels[i][node]
            weakest = items.least[items.leaves[a][0] : items.leaves[b - 1][1]].min()
            bound = _bounds(maxima[d], own, items.nodes[i][node])
            may = bound >= weakest
            kept[node], bounds[node] = own[may], bound[may]
        if d == len(levels) - 1 and i == len(items.levels) - 1:
            break
        if d < len(levels) - 1:
            d, child = d + 1, len(levels[d + 1])
            kept = {node: (own[:, None] * FAN + np.arange(FAN)).reshape(-1) for node, own in kept.items()}
            kept = {node: own[own < child] for node, own in kept.items()}
        if i < len(items.levels) - 1:
            i, child = i + 1, len(items.levels[i + 1])
            kept = {below: own for node, own in kept.items() for below in range(node * FAN, min(node * FAN + FAN, child))}
        pairs = kept
    # A leaf of documents at a time, those with the best prospects first, so that results improve early.
    leaf = np.repeat(np.fromiter(kept, np.int64, len(kept)), [own.size for own in kept.values()])
    node = np.concatenate([*kept.values(), np.zeros(0, np.int64)]).astype(np.int64)
    bound = np.concatenate([*bounds.values(), np.zeros(0)])
    weakest = np.array([items.least[a:b].min() for a, b in items.leaves])
    prospect = np.zeros(len(leaves))
    np.maximum.at(prospect, node, bound / weakest[leaf])
    scored = 0
    order = np.lexsort((node, -prospect[node]))
    for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
        terms = None
        for k in own:
            a, b = items.leaves[leaf[k]]
            if bound[k] < items.least[a:b].min():
                continue
            first, last = leaves[node[k]]
            if terms is None:
                part = slice(docs.at[first], docs.at[last])
                terms, place = np.unique(docs.terms[part], return_inverse=True)
                dense = np.zeros((last - first, terms.size))
                dense[np.repeat(np.arange(last - first), np.diff(docs.at[first : last + 1])), place] = docs.values[part]
            lookup, block = items.blocks[leaf[k]]
            row = lookup[terms]
            shared = row >= 0
            scores = dense[:, shared] @ block[row[shared]]
            enters = scores >= items.least[a:b]
            for j in np.flatnonzero(enters.any(0)):
                those = np.flatnonzero(enters[:, j])
                items.offer(a + int(j), scores[those, j], ids[first + those], known[first + those])
            scored += 1
    return scored


def _bounds(nodes: Rows, own: np.ndarray, maxima: np.ndarray) -> np.ndarray:
    """The product of each of the nodes' maxima with those of an item node."""
    if not own.size:
        return np.zeros(0)
    part = nodes.take(own)
    out = np.zeros(own.size)
    filled = np.flatnonzero(np.diff(part.at))
    if filled.size:
        out[filled] = np.add.reduceat(part.values * maxima[part.terms], part.at[filled])
    return out * (1 + 1e-9)  # more than what rounding of large sums can take away


# Spark ----------------------------------------------------------------------------------------------


def _parsed(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items as (item_id, terms), one for each id and text, with a block of their own."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _FROM, _FROM.lower())
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text.alias("text")).distinct()
    return rows.select("item_id", "text", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))).alias("terms")).filter(F.size("terms") > 0)


def _counted(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of every text with terms, stored; the vocabulary's terms only, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_by_bytes(whole, 1):
                total, row, term, count = term_counts(batch.column(1), vocabulary)
                at = np.searchsorted(row, np.arange(batch.num_rows + 1))
                terms, counts = term.astype("<i4"), count.astype("<i4")
                has = np.flatnonzero(total)
                columns = [batch.column(0).take(pa.array(has)), total[has], [terms[at[k] : at[k + 1]].tobytes() for k in has], [counts[at[k] : at[k + 1]].tobytes() for k in has]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

    return stored(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n long, terms binary, counts binary"), "search-counts")


def _holding(counted: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            raw, _ = _binary(batch.column(0))
            held += np.bincount(raw, minlength=size)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(held[term], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for row in counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]  # at most the vocabulary of a block of items
    return out


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of a column of packed 32-bit integers."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), "<i4"), (offsets - offsets[0]) // 4


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, known, n, offsets, terms, counts) of as many documents as a tree takes."""
    held: list[pa.RecordBatch] = []
    docs = counts = 0

    def joined() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, at = _binary(table["terms"].chunk(0))
        ids = table["id"].chunk(0)
        return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), table["n"].to_numpy(), at, terms, _binary(table["counts"].chunk(0))[0]

    for whole in batches:
        sizes = np.cumsum(pc.binary_length(whole.column(2)).to_numpy() // 4)
        first = 0
        while first < whole.num_rows:
            gone = sizes[first - 1] if first else 0
            last = int(np.searchsorted(sizes, gone + TREE_COUNTS - counts, side="right"))
            last = min(max(last, first + (0 if held else 1)), first + TREE_DOCS - docs, whole.num_rows)
            if last > first:
                held.append(whole.slice(first, last - first))
                docs, counts = docs + last - first, counts + int(sizes[last - 1] - gone)
            if last < whole.num_rows:
                yield joined()
                held, docs, counts = [], 0, 0
            first = last
    if held:
        yield joined()


def _ranked(found: DataFrame, key: str, best: int) -> DataFrame:
    """(key, rank, id, score) of the best of (key, part, score, id): of each part first, then of all."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for keys in ([key, "part"], [key]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    return found.select(key, "rank", "id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's ``best`` documents by score: item id, rank, document id, score."""
    parsed = stored(_parsed(items, item_col, item_text_col), "search-items")
    size = parsed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // block_bytes))
    parsed = parsed.select("item_id", "terms", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = None
    for block in range(blocks):
        rows = sorted(parsed.filter(F.col("block") == block).collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["terms"]))
        if rows or out is None:
            found = _rank_block(docs, [(r["item_id"], r["terms"]) for r in rows], best, id_col, text_col, item_col)
            out = found if out is None else out.unionByName(found)
    return out


def _rank_block(docs: DataFrame, items: list[tuple[int | None, list[str]]], best: int, id_col: str, text_col: str, item_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = pa.array(sorted({t for _, terms in items for t in terms}), pa.large_string())
    counted = _counted(docs, vocabulary, id_col, text_col)
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    n, length = total["n"], total["length"]
    df = _holding(counted, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    place = {t: k for k, t in enumerate(vocabulary.to_pylist())}
    rows = [np.array(sorted(place[t] for t in terms), np.int64) for _, terms in items]
    at = np.concatenate(([0], np.cumsum([r.size for r in rows]))).astype(np.int64)
    terms = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    if rows and max(int(weight[r].sum()) for r in rows) * 1_000_000 >= 1 << 53:
        raise ValueError("scores of these items are too large for exact sums")
    query = Rows(at, terms, weight[terms].astype(np.float64))
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Items(query, size, best)
        for ids, known, lengths, at, own, counts in _batches(batches):
            m = 50 + (50 * lengths * n) // length
            count = counts.astype(np.int64)
            value = (1_000_000_000 * count) // (1000 * count + 20 * np.repeat(m, np.diff(at)))
            search(tree, Rows(at, own.astype(np.int64), value.astype(np.float64)), ids, known, weight)
        for k, item in enumerate(tree.order.tolist()):
            scores, ids, known = tree.settle(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(ids.size, item), pa.int32()), pa.array(scores.astype(np.int64)), pa.array(ids, pa.int64(), mask=~known)], schema=_FOUND)

    found = counted.mapInArrow(run, "item int, score long, id long").withColumn("part", F.spark_partition_id() % 256)
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(items)], f"item int, {item_col} long")
    best_of = stored(_ranked(found, "item", best), "search-best")
    return best_of.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")  # a block of items at most
