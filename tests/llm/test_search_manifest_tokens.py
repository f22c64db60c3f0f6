"""Dual-tree search, Merkle manifests and token files against brute force, and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from storyweft.llm import dual_tree, merkle, packing, token_files
from storyweft.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows_of

FILE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    got, want = QUERIES[name](spark, data).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# Search ---------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, best):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, (t or "").translate(LOWER)) for i, t in items}:
        scores = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms_of(text)) & set(b))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "日本", "ÉÉ", "x_y", "A1b", "İ"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(600)]
    docs += [(i, docs[5][1]) for i in range(600, 700)]  # ties
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, docs[5][1]), (800, None), (801, ""), (802, " .,\x7f"), (803, "W1 " * 50_000 + "日本")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(70)]
    items += [(1, "w1 w2"), (2, items[2][1]), (100, None), (101, "unheard of"), (None, "w3 É"), (102, docs[5][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit("x"))
    want = brute_search(docs, items, 7)
    # Trees of all sizes, blocks of items, and documents with more terms than a leaf takes.
    for settings, blocks in (({}, 512), ({"TREE_DOCS": 90, "DOC_LEAF": 2, "ITEM_LEAF": 2, "FAN": 2}, 40), ({"LEAF_CELLS": 40, "TREE_COUNTS": 300}, 1000)):
        for name, value in settings.items():
            monkeypatch.setattr(dual_tree, name, value)
        got = [tuple(r) for r in dual_tree.rank_documents(table, asked, 7, block_items=blocks).collect()]
        assert sorted(got, key=str) == want
    assert dual_tree.rank_documents(table.limit(0), asked).count() == 0
    assert dual_tree.rank_documents(table, asked.limit(0)).count() == 0


def test_search_leaves_whole_batches_out():
    """Documents of other topics are never scored, and all that could enter are."""
    rng = np.random.default_rng(1)
    topics, own = 40, 25

    def rows(n):
        terms = [np.sort(rng.choice(own, 8, replace=False) + own * (k % topics)) for k in range(n)]
        at = np.arange(n + 1) * 8
        return dual_tree.Rows(at, np.concatenate(terms), rng.integers(1, 1000, 8 * n).astype(float))

    docs, query = rows(8000), rows(400)
    items = dual_tree.Items(query, topics * own, 10)
    scored = dual_tree.search(items, docs, np.arange(8000), np.ones(8000, bool), np.ones(topics * own))
    assert scored < 0.2 * (8000 / dual_tree.DOC_LEAF) * len(items.leaves)
    d, q = np.zeros((8000, topics * own)), np.zeros((400, topics * own))
    for dense, sparse in ((d, docs), (q, query)):
        dense[np.repeat(np.arange(len(dense)), 8), sparse.terms] = sparse.values
    full = q @ d.T
    for k, item in enumerate(items.order.tolist()):
        best = np.lexsort((np.arange(8000), -full[item]))[:10]
        scores, ids, _ = items.settle(k)
        assert ids.tolist() == best.tolist() and scores.tolist() == full[item][best].tolist()


# Manifest -------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, tampered):
    def leaf(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k in range(len(nodes)):
                run = level[at[k] // 3 * 3 : at[k] // 3 * 3 + 3]
                paths[k].append((run[: at[k] % 3], run[at[k] % 3 + 1 :]))
                at[k] //= 3
            level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        return level[0] if level else None, paths

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), leaf(tampered(row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (known, i, own, other), path in zip(groups[g], trees[g][1], strict=True):
            folded = other
            for left, right in path + top:
                folded = h(*left, folded, *right)
            out.append((i if known else None, own, trees[g][0], root, h(*(x for left, right in path + top for x in left + right)), folded, folded == root))
    return sorted(out, key=str)


def strip_even(row):
    i, source, lang, n, text = row
    return (i, source, lang, n, text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text)


def manifest_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("id", F.lit("x")).withColumn("at", F.lit(None).cast("string"))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.build(df.repartition(5), tampered={"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})


def test_manifest(spark):
    rng = random.Random(9)
    ids = [rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(-70_000, 70_000), rng.randint(0, 3000)]) for _ in range(3000)]
    rows = [(i, rng.choice(["a", "b", "é", "", "a", "a", "a", None]), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["x", "one\ntwo", "", None, "日本\n"])) for i in ids]
    rows += [(7, "a", "en", 1, f"text {k % 50}\n") for k in range(300)] + [(None, "a", "en", 1, f"t{k % 3}") for k in range(40)] + [(None, None, None, None, None)] * 3 + [(1, "lone", "en", 1, "x\n" * 50_000)]
    manifest = manifest_of(spark, rows)
    got = merkle.proofs(manifest).collect()
    assert sorted((tuple(r[:7]) for r in got), key=str) == brute_manifest(rows, strip_even)
    assert all(merkle.verify(r["leaf"], r["proof"], manifest.root) for r in got[:200])
    assert not merkle.verify(h("other"), got[0]["proof"], manifest.root)


def test_manifest_of_many_blocks_and_groups(spark):
    """Paths lead to the root of any number of leaves; a group of several blocks, and many groups."""
    rows = [(k * 3, "hot", "en", k, f"t{k}\n") for k in range(7000)] + [(k, f"s{k % 40}", "en", k, "x") for k in range(81)]
    assert merkle._levels(1000) == 7 and merkle.parents(["a", "b", "c", "d"]) == [h("a", "b", "c"), h("d")]
    own = merkle.paths([h(str(k)) for k in range(10)], 3)
    level = [h(str(k)) for k in range(10)]
    while len(level) > 1:
        level = merkle.parents(level)
    assert all(merkle.fold(h(str(k)), own[k]) == level[0] for k in range(10))
    assert sorted((tuple(r) for r in merkle.proofs(manifest_of(spark, rows), keep_proofs=False).collect()), key=str) == brute_manifest(rows, strip_even)


def test_manifest_of_nothing_and_one(spark):
    empty = manifest_of(spark, [])
    assert empty.root is None and merkle.proofs(empty).count() == 0
    one = manifest_of(spark, [(4, None, None, None, None)])
    row = merkle.proofs(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == one.root == row["folded_root"] and row["proof_sha256"] == h()


def test_bitmaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 4095, 4096, 4097, 65536):
        held = np.sort(rng.choice(65536, n, replace=False))
        packed = merkle.compress(held)
        assert len(packed) <= 8192 and (merkle.positions(packed) == held).all()


# Token files ----------------------------------------------------------------------------------------


def test_bit_packing():
    rng = np.random.default_rng(1)
    for bits in range(1, 33):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
            data = token_files.pack(ids, bits)
            assert len(data) == (n * bits + 7) // 8 and (token_files.unpack(data, n, bits) == ids).all()
            number = sum(int(i) << bits * k for k, i in enumerate(ids))
            assert data == number.to_bytes((n * bits + 7) // 8, "little")
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(1) == 1 and token_files.bits_for(65537) == 17
    with pytest.raises(ValueError):
        token_files.pack(np.array([8]), 3)


def test_token_file_random_access(tmp_path):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 1 << 15, n) for n in (1, 100, 0, 64, 20_000, 3, 64, 128)]
    writer = token_files.TokenWriter(f"file://{tmp_path}/a/x.bin", 15, 64)
    for k, ids in enumerate(docs):
        writer.add(None if k == 0 else max(k, 2), ids.astype(np.uint16))
    assert writer.close()[1:] == (2, 7, 8, sum(d.size for d in docs))
    reader = token_files.TokenReader(f"file://{tmp_path}/a/x.bin")
    everything = np.concatenate(docs)
    for _ in range(200):
        a, b = sorted(rng.integers(0, everything.size + 1, 2).tolist())
        assert (reader.ids(a, b) == everything[a:b]).all()
    assert [d.tolist() for d in reader.document(2)] == [docs[1].tolist(), docs[2].tolist()] and reader.document(9) == []
    assert [np.frombuffer(p, "<u4").tolist() for _, _, pieces in reader.documents() for p in pieces] == [d.tolist() for d in docs]
    data = bytearray(open(f"{tmp_path}/a/x.bin", "rb").read())
    open(f"{tmp_path}/a/y.bin", "wb").write(data[:-1])
    with pytest.raises(ValueError):
        token_files.TokenReader(f"file://{tmp_path}/a/y.bin")


def test_token_files(spark, data):
    library = packing.loaded(FILE).library
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(500, None), (501, ""), (None, "lost"), (None, "again"), (-5, "below zero"), (3, "other text of an id")] + [(502, "the same")] * 200 + [(503, "word " * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("row", F.lit(1)).withColumn("id", F.lit("y")).repartition(6)
    index = token_files.write_token_files(df, FILE, file_ids=20_000)
    assert index.count() > 4
    rows = token_files.read_token_files(index).collect()
    own = defaultdict(list)
    for i, text in docs:
        own[i].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    at = 0
    assert len(rows) == len(docs)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        own[r["doc_id"]].remove(bytes(r["ids"]))
        at += r["n_tokens"]
    assert not any(own.values())
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert token_files.read_document(index, -5)[0].tolist() == [*library.encode("below zero", add_special_tokens=False).ids, 2]
    assert len(token_files.read_document(index, 502)) == 200 and token_files.read_document(index, 999) == []
    nothing = token_files.write_token_files(df.limit(0), FILE)
    assert nothing.count() == 0 and token_files.read_token_files(nothing).count() == 0
    assert pa.types.is_int64(token_files._READ.field("start").type)
