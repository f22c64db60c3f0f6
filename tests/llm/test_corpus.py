"""Corpus operators against brute force, and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from storyweft.llm import embedding_dedup, gru_lm, hilbert, jaccard_join, langid, packing, pii, sentencepiece_bpe, sharding, warc
from storyweft.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, size int, bucket string, node string, rank int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra columns whose names operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e f g", "a b c d e f g", long, long + " x", "é 日本 🙂 mail a@b.co", "1" * 5000]
    rows = [(i, t, "en" if i % 2 else None, i, "b", "n", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "a b c d e f g", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, edge, empty):
    for df in (docs, edge):
        got = sharding.assign_shards(df, 40).collect()
        assert len(got) == df.count()
        assert all(r["shard"] == jump(r["doc_id"] or 0, 40) and r["grown_shard"] == jump(r["doc_id"] or 0, 41) for r in got)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    crc = {r["doc_id"]: (r["text_crc32"], r["size"]) for r in sharding.assign_shards(docs, 40).collect()}
    assert all(crc[r["doc_id"]] == (zlib.crc32(r["text"].encode()), len(r["text"].encode()) + 16) for r in docs.collect())
    assert sharding.assign_shards(empty, 40).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 3000
    rows = [(1, "http://a/", big), (2, "http://b/\r\n", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 2_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    index = warc.archive(pages)
    got = {r["page_id"]: r for r in warc.read_bundles(index).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["url"] == url
        refers = 2 if html == big and i != 2 else None
        assert r["refers_to"] == refers and r["record_type"] == ("revisit" if refers else "response")
        assert r["payload"] is None if refers else bytes(r["payload"]) == raw
    assert bytes(warc.read_record(index, 7)[0][-1]) == ("é" * 2_000_000).encode()
    assert warc.read_bundles(warc.archive(pages.limit(0))).count() == 0


def test_language_model(spark, docs, edge, empty):
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    for df in (docs, edge):
        got = gru_lm.score_documents(df, learns, rounds=1).collect()
        rows = df.select("doc_id", "text").collect()
        assert len(got) == len(rows)
        held = {r["doc_id"]: r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows}
        counts = Counter(w for r in rows if not held[r["doc_id"]] for w in [*words(r["text"]), "\0"])
        total, kinds = sum(counts.values()), len(counts)
        text = {r["doc_id"]: r["text"] for r in rows}
        for r in got:
            own = [*words(text[r["doc_id"]]), "\0"]
            base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
            assert r["n_tokens"] == len(own) and r["n_known"] == sum(w in counts for w in own) and r["train_tokens"] == total
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["held_out"] == held[r["doc_id"]] and r["score"] <= 0
    got = gru_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), learns).collect()
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in unseen) >= 0.95 * len(unseen)
    assert sum(r["score"] - r["base_score"] for r in unseen) >= 0.1 * sum(r["n_tokens"] for r in unseen)
    assert gru_lm.score_documents(empty, learns, rounds=1).count() == 0


def test_gru_is_a_distribution_and_keeps_state():
    rng = np.random.default_rng(0)
    model = gru_lm.Gru(rng.integers(1, 50, 90).astype(float), hidden=8, classes=7)
    model.p["word"] += rng.normal(0, 0.3, model.p["word"].shape).astype(np.float32)
    model.p["class"] += rng.normal(0, 0.3, model.p["class"].shape).astype(np.float32)
    states = rng.normal(size=(1, 8)).astype(np.float32).repeat(90, axis=0)
    assert np.exp(model.log_probabilities(states, np.arange(90))).sum() == pytest.approx(1, abs=1e-4)
    texts = [rng.integers(0, 90, n) for n in (1, 50, 7, 300, 2)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = model.score(np.concatenate(texts), offsets, 0, lanes=2)
    for t, got in zip(texts, together, strict=True):
        h, want, before = np.zeros((1, 8), np.float32), 0.0, 0
        for x in t:
            new = np.empty_like(h)
            model.step(model.p["input"][[before]], h, np.empty((1, 24), np.float32), np.empty_like(h), new)
            h = new
            want += model.log_probabilities(h, np.array([x]))[0]
            before = x
        assert got == pytest.approx(want, rel=1e-4)


def test_gru_gradients():
    rng = np.random.default_rng(4)
    model = gru_lm.Gru(rng.integers(1, 30, 40).astype(float), hidden=6, classes=5)
    for name in ("word", "class"):
        model.p[name] += rng.normal(0, 0.5, model.p[name].shape).astype(np.float32)
    start = {name: x.astype(float) for name, x in model.p.items()}
    texts = [rng.integers(0, 40, n) for n in (3, 9, 5)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    symbols = np.concatenate(texts)

    def loss(p):
        model.p = {name: x.copy() for name, x in p.items()}
        return -model.score(symbols, offsets, 7, lanes=2).sum() / symbols.size

    steps = {}
    model.p = {name: x.astype(np.float32) for name, x in start.items()}
    model._learn = lambda name, where, gradient, rate: steps.setdefault(name, []).append((where, gradient.copy()))
    model.train(symbols, offsets, 7, lanes=2, window=100)
    for name, x in start.items():
        found = np.zeros_like(x)
        for where, gradient in steps[name]:
            found[where] += gradient
        for at in rng.choice(x.size, 25):
            moved = {n: y.copy() for n, y in start.items()}
            moved[name].flat[at] += 1e-4
            up = loss(moved)
            moved[name].flat[at] -= 2e-4
            assert found.flat[at] == pytest.approx((up - loss(moved)) / 2e-4, abs=2e-4)


def test_language_id(docs, edge, empty):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    models = langid.train(docs.filter(fold != 2))
    got = langid.identify(docs, models).join(docs.select("doc_id", "lang", (fold == 2).alias("held")), "doc_id")
    right = got.filter("held").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95
    assert got.filter("rejected").count() <= 2
    by_id = {r["doc_id"]: r for r in langid.identify(edge, models).collect()}
    assert len(by_id) == 12 and all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 10))
    assert all(0 <= r["score"] <= 1 for r in by_id.values())
    assert langid.identify(empty, models).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge, langid.train(empty)).collect()} == {"und"}


def test_sentencepiece_is_exact(docs, edge, empty):
    file = public_tokenizers.path("piece_bpe_32k.model")
    bpe = sentencepiece_bpe.loaded(file)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeothnris  \nABé.,1234-▁ç日🙂") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * 40, "a" * 3000, "ab" * 2000, "<s></s><unk><0x41>", "x\x00y", "́a"]
    for t in texts:
        ids = bpe.library.encode(t, add_bos=True, add_eos=True)
        assert list(memoryview(bpe.encode(t)).cast("I")) == ids
        assert bpe.decode(bpe.encode(t)).decode() == bpe.library.decode(ids)
    for df in (docs, edge):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        got = sentencepiece_bpe.encode_documents(df, file).collect()
        assert len(got) == df.count()
        for r in got:
            ids = np.array(bpe.library.encode(text[r["doc_id"]], add_bos=True, add_eos=True), "<u4").tobytes()
            assert r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and bytes(r["ids"]) == ids
    assert sentencepiece_bpe.encode_documents(empty, file).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15)
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark, docs):
    rng = random.Random(5)
    parts = ["a", "b1", "@", ".", "-", "_", "%", "+1", " ", "4", "255", "256", ".1", "(", ")", "x@y.z", "4111 1111 1111 1111", "+1 (386) 555-8773", "é", "🙂", "1.2.3.4", "0", "00", ".0", "10.0.0.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["10.0.0.1", "192.168.0.1", "0.0.0.0", "000.0.00.255", "0.0.0.0256", "1.0.0.300", "0" * 4_000 + "1.0.0.256", "0" * 4_000 + "1.0.0.255", "a@" + "b." * 20_000 + "c", "1" * 50_000, "1." * 30_000, "a" * 50_000, "+1" + " " * 30_000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df, {}).select("doc_id", pii.digest(F.col("base")).alias("b")).collect():
        assert r["b"] == base_pii(texts[r["doc_id"]] or "")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find(docs, {}).select("doc_id", pii.digest(F.col("base")).alias("b")).collect():
        assert r["b"] == base_pii(text[r["doc_id"]])


def test_addresses_with_zero_parts_are_masked(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.1 and 8.8.8.8, 192.168.0.1 or 0.0.0.0 but 10.0.0.256")], "doc_id long, text string")
    assert pii.mask_documents(df, {}).first()["text"].count(".") == 3


def test_pii_bootstrapping(spark, edge, empty):
    texts = [f"Please call me +1 (386) 555-{i:04d} today" for i in range(60)] + [f"Please call me 386 555 {i:04d} today" for i in range(8)] + [f"i think of the x{i} and" for i in range(300)] + [f"one of the +1 (386) 555-{i:04d} now" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = pii.learn_patterns(df)
    assert patterns == {"phone": ["call me"]}
    found = {r["doc_id"]: r["s"] for r in pii.find(df, patterns).select("doc_id", pii.digest(F.col("spans")).alias("s")).collect()}
    assert found[60] == "phone:15:27" and found[100] == ""
    masked = pii.mask_documents(df, patterns).filter("doc_id = 60").first()["text"]
    assert masked == "Please call me <PHONE> today"
    assert pii.learn_patterns(empty) == {} and pii.find(empty, {}).count() == 0
    assert pii.mask_documents(edge, {}).count() == 13 and pii.mask_documents(edge, {}).columns == edge.columns


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(1200):
        v = centres[i % 40] + rng.normal(size=16) * (0.05 if i % 3 else 0.3)
        rows.append((i, [float(np.float32(x)) for x in v], i % 4))
    rows += [(2000 + i, rows[5][1], 1) for i in range(30)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None] * 16, 1), (3005, rows[5][1], None), (3006, [1.0, 2.0], 1)]
    return rows, vectors(spark, rows)


def unit(rows):
    good = [(i, np.array(v, float), label) for i, v, label in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([v for _, v, _ in good])
    return np.array([i for i, _, _ in good]), m / np.linalg.norm(m, axis=1)[:, None], [label for _, _, label in good]


def test_nearest_neighbours(spark, clustered):
    rows, df = clustered
    ids, m, _ = unit(rows)
    got = hilbert.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    found = defaultdict(list)
    for r in got:
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]]
        own = sorted(found[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
        hits, total = hits + len(set(best) & {v for _, v, _ in own}), total + 5
    assert hits / total >= 0.9
    assert hilbert.nearest(df.limit(0), F.lit(True), 5).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    place = hilbert.curve_index(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_embedding_dedup(spark, clustered):
    rows, df = clustered
    ids, m, labels = unit(rows)
    labels = np.array([-1 if x is None else x for x in labels])
    linked = (m @ m.T >= 0.98) & (labels[:, None] == labels[None, :]) & (labels[:, None] >= 0)
    np.fill_diagonal(linked, False)
    root = components(len(ids), zip(*np.nonzero(linked), strict=True))
    least = {r: min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    for cell, chunk in ((2048, 1024), (40, 16)):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, cell=cell, chunk=chunk).collect()}
        assert len(got) == len(rows)
        for k, i in enumerate(ids):
            assert (got[i]["n_links"], got[i]["component_id"]) == (linked[k].sum(), least[root[k]])
            assert got[i]["kept"] == (least[root[k]] == i)
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(3000, 3007))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_packing(docs, edge, empty):
    file = public_tokenizers.path("word_bpe_49k.json")
    library = packing.loaded(file).library
    for df, window in ((docs, 4096), (edge, 64)):
        want = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            want[r["doc_id"]].append(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
        rows = packing.pack_documents(df, file, window=window).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in rows:
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at == window or at & (at - 1) == 0
        for doc, texts in want.items():
            assert sum(len(b) for _, b in pieces[doc]) == sum(map(len, texts))
            if len(texts) == 1:
                assert b"".join(b for _, b in sorted(pieces[doc])) == texts[0]
    assert packing.pack_documents(empty, file).count() == 0


def test_packing_tokenizer_is_exact():
    tokenizer = packing.loaded(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    parts = ["a", "The", "'s", "İ", "Σ", "ß", "é", "é", " ", "\n", "\t", " ", ".", ",", "<|endoftext|>", "1", "日", "\x1c", "--", "?"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert tokenizer.encode(pa.array([text]))[0].tolist() == tokenizer.library.encode(text, add_special_tokens=False).ids


def brute_jaccard(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    pairs = []
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                pairs.append((j, i))
    return sets, components(len(rows), pairs)


def test_jaccard_join(spark, docs, edge, empty):
    rng = random.Random(2)
    base = [f"v{i}" for i in range(120)]
    family = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"n{rng.random()}"
        family.append(" ".join(w))
    many = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    for df in (docs, edge.filter("doc_id is not null"), many):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        sets, root = brute_jaccard(rows)
        least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
        want = sorted((rows[k][0], len(sets[k]), least[root[k]]) for k in range(len(rows)))
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(df).collect())
        assert got == want
    assert jaccard_join.similarity_components(empty).count() == 0
    assert jaccard_join.similarity_components(edge).filter("doc_id is null").first()["component_id"] is None


def test_pipeline(spark, docs, data):
    import corpus_pipeline as cp

    kept, columns = docs, docs.columns
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = cp.stored(stage(spark, kept, data), "test")
        if name == "packing":
            break
        assert kept.columns == columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "language_id":
            assert len(before) - len(after) <= 2
        if name == "near_duplicates":
            _, root = brute_jaccard(sorted(before.items()))
            assert set(after) == {sorted(before)[r] for r in set(root)}
        if name == "personal_data":
            assert set(after) == set(before) and not any(base_pii(t) for t in after.values())
    assert {r["doc_id"] for r in kept.collect()} == set(after)


CONTRACT = {
    1: {"doc_id": "bigint", "size": None, "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    2: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    3: {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    4: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    5: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    6: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    7: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    8: {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    9: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    10: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    11: {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    12: {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    13: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_keeps_its_contract(spark, data, name):
    number = int(re.match(r"op(\d+)_", name)[1])
    rows = QUERIES[name](spark, data)
    kinds = dict(rows.dtypes)
    for column, kind in CONTRACT[number].items():
        assert column in kinds and kind in (None, kinds[column]), (column, kinds)
    got = rows.collect()
    table = "pages" if number == 2 else "embeddings" if number in (7, 10) else "documents"
    key = "page_id" if number == 2 else "vec_id" if number in (7, 10) else "doc_id"
    source = spark.read.parquet(f"{data}/{table}.parquet")
    if number == 7:
        asked = {r["vec_id"] for r in source.filter("vec_id % 50 = 0 AND embedding IS NOT NULL").select("vec_id").collect()}
        assert {r["query_id"] for r in got} == asked and len(got) == 5 * len(asked)
    elif number == 11:
        assert max(r["rank"] for r in got) == 50 and len({(r["item_id"], r["rank"]) for r in got}) == len(got)
    elif number == 8:
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in source.select("doc_id").collect()}
        assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    else:
        assert sorted(r[key] for r in got) == sorted(r[key] for r in source.select(key).collect())
    if number in (3, 4):
        divisor = 7 if number == 3 else 4
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == 2) for r in got)
    if number == 6:
        text = {r["doc_id"]: r["text"] or "" for r in source.collect()}
        for r in got:
            assert r["base_sha256"] == hashlib.sha256(base_pii(text[r["doc_id"]]).encode()).hexdigest()
            assert r["spans"] == base_pii(text[r["doc_id"]])  # these texts hold no pattern that could be learned


def test_recall_of_the_neighbour_query(spark):
    """On vectors without structure, at a size where windows are a share of the table, with the shipped defaults."""
    n = 8000
    m = np.random.default_rng(5).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    m /= np.linalg.norm(m, axis=1)[:, None]
    found = defaultdict(set)
    for r in hilbert.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in range(0, n, 50):
        score = m @ m[q]
        score[q] = -9
        hits, total = hits + len(set(np.argsort(-score)[:5].tolist()) & found[q]), total + 5
    assert hits / total >= 0.9


def test_neighbours_of_ties_repeats_and_singles(spark):
    rows = [(i, [1.0, 0.0], 0) for i in (4, 2, 9, 2)] + [(50, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (100, [3.0], 0), (150, None, 0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, 3).collect())
    assert [x[:3] for x in got if x[0] == 50] == [(50, 1, 2), (50, 2, 4), (50, 3, 9)] and all(x[3] == 1.0 for x in got)
    assert not [x for x in got if x[0] in (100, 150)]
    one = vectors(spark, [(50, [1.0, 2.0], 0)])
    assert hilbert.nearest(one, F.lit(True), 5).count() == 0


def test_visitors_are_dealt_to_bounded_tasks(spark, clustered):
    _, df = clustered
    want = sorted(map(tuple, hilbert.nearest(df, F.col("vec_id") % 20 == 0, 3).collect()))
    got = sorted(map(tuple, hilbert.nearest(df, F.col("vec_id") % 20 == 0, 3, block=100, visitors=7).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_rearranged_words_have_other_hashes(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y {one} z w"), (2, f"x y {two} z w"), (3, f"x y {one} z w")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    scored = {r["doc_id"]: r for r in gru_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1, rounds=1).collect()}
    assert (scored[1]["n_known"], scored[2]["n_known"], scored[3]["n_known"]) == (6, 5, 6)  # with the end


def test_groups_of_a_token_meet_in_chunks(spark):
    rows = spark.createDataFrame([(t, g) for t in (1, 2) for g in range(30)], "token long, group long")
    sizes = spark.createDataFrame([(g, 10 if g < 20 else 100, 10 if g < 20 else 100) for g in range(30)], "group long, least long, most long")
    got = sorted(map(tuple, jaccard_join.meetings(rows, sizes, 75, meeting=4).collect()))
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30) if (a < 20) == (b < 20)]


def naive_kneser_ney(texts, order):
    """Interpolated Kneser-Ney as its definition says, over folded texts; log-probability of a character by its context."""
    tables = []
    for k in range(order):
        grams = Counter()
        if k == order - 1:
            for t in texts:
                p = "^" * (order - 1) + t
                grams.update(p[i : i + order] for i in range(len(t)))
        else:
            longer = set()
            for t in texts:
                p = "^" * order + t
                longer |= {p[i + order - k - 1 : i + order + 1] for i in range(len(t))}
            grams.update(g[1:] for g in longer)
        ones, twos = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
        tables.append((grams, ones / (ones + 2 * twos) if ones and twos else 0.5))

    def probability(gram, uniform):
        k = len(gram) - 1
        grams, discount = tables[k]
        own = {g: c for g, c in grams.items() if g[:-1] == gram[:-1]}
        below = uniform if k == 0 else probability(gram[1:], uniform)
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(gram, 0) - discount, 0) / total + discount * len(own) / total * below

    return tables, probability


def test_language_models_are_kneser_ney():
    rng = random.Random(8)
    texts = {"x": [" " + "".join(rng.choice("abc ") for _ in range(60)).replace("  ", " ").strip() for _ in range(12)], "y": [" " + "".join(rng.choice("abdd ") for _ in range(60)).replace("  ", " ").strip() for _ in range(12)]}
    for name in texts:
        texts[name] = [re.sub(" +", " ", t) for t in texts[name]]
    models = langid.fit({k: [t[1:] for t in v] for k, v in texts.items()}, 3)
    letters = len({c for v in texts.values() for t in v for c in t})
    for j, name in enumerate(models.languages):
        kept = [t for i, t in enumerate(texts[name]) if i % langid.CALIBRATION]
        _, probability = naive_kneser_ney(kept, 3)
        for t in (" abca b", " ddabc", " bbb"):
            padded = "^^" + t
            want = -sum(math.log(probability(padded[i : i + 3], 1 / (4 * max(2, letters)))) for i in range(len(t))) / len(t)
            assert models.entropies(pa.array([t[1:]]))[0][0, j] == pytest.approx(want, rel=1e-4), (name, t)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_rejection_works_at_every_size(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    models = langid.train(docs)
    rng = random.Random(4)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(n)) for n in (30, 60, 200, 2000)] + ["Это русский текст о погоде и природе нашей страны", "これは日本語の文章です。漢字も仮名もあります"]
    rows = langid.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), models).collect()
    assert all(r["rejected"] for r in rows)
    assert langid.filter_identified(docs, models).count() >= 0.99 * docs.count()


def test_long_labelled_texts_are_learned_from(spark):
    words_of = {"p": "alpha beta gamma delta", "q": "uno dos tres cuatro"}
    rows = [(i, " ".join(random.Random(i).choice(words_of[lang].split()) for _ in range(8000)), lang) for i, lang in enumerate("pq" * 6)]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.languages == ["p", "q"] and models.predict(pa.array(["beta gamma alpha", "tres dos uno"]))[0] == ["p", "q"]


def test_pii_second_generation(spark):
    texts = [f"Please call me +1 (386) 555-{i:04d} today" for i in range(30)]
    texts += [f"Please call me 386 777 {i:04d} today" for i in range(12)]
    texts += [f"they should ring 386 777 {i:04d} now" for i in range(12)] + [f"they should ring 212 888 {i:04d} now" for i in range(5)]
    texts += [f"in year 386 999 {i:04d} now" for i in range(5)] + [f"one of the {w} things" for w in ("red", "blue")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = pii.learn_patterns(df)
    assert patterns == {"phone": ["call me", "should ring"]}  # the second one stands before no seed
    got = [r["s"] for r in pii.find(df, patterns).orderBy("doc_id").select(pii.digest(F.col("spans")).alias("s")).collect()]
    assert got[30] == "phone:15:27" and got[45] == got[57] == "phone:17:29" and not any(got[59:])
    both = spark.createDataFrame([(1, texts[0], "b", "k"), (1, texts[0], "b", "k"), (2, None, None, None), (3, "", "", "")], "doc_id long, text string, base string, kind string")
    rows = pii.mask_documents(both, patterns).collect()
    assert sorted(str(r["text"]) for r in rows) == ["", "None", "Please call me <PHONE> today", "Please call me <PHONE> today"] and rows[0]["base"] is not None


def test_warc_ties_and_clashing_names(spark):
    big = "y" * 2000
    rows = [(3, "u", big, 1, "t"), (3, "v", big, 2, "t"), (1, "u", big, 3, "t"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, salt int, top string").withColumn("n", F.lit(0))
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.archive(pages)).collect())
    assert [g[0] for g in got] == [0, 1, 3, 3] and (1, "revisit", 3) in got and got[0] == (0, "response", None)
    assert sum(g[:2] == (3, "response") for g in got) >= 1


def test_packing_places_by_least_squares():
    rng = np.random.default_rng(9)
    packer = packing.SumOfSquares(window=64)
    for d in range(300):
        before = packer.levels.copy()
        size = int(rng.integers(1, 64))
        packer.add((d, size), b"\1\0\0\0" * size)
        after = packer.levels.copy()

        def cost(level):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 64:
                n[level + size] += 1
            return (n**2).sum()

        options = [0, *[h for h in range(1, 65 - size) if before[h]]]
        assert (after**2).sum() == min(map(cost, options))


def test_packing_repeats_and_clashing_names(spark):
    file = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, "a b c", 0, 0)] * 3 + [(None, None, 0, 0)], "doc_id long, text string, start int, offset int")
    got = packing.pack_documents(rows, file).collect()
    assert sum(r["length"] for r in got) == 3 * 4 + 1 and sum(r["doc_id"] is None for r in got) == 1


def test_double_vectors_keep_their_digits(spark):
    angle = math.acos(0.98)
    rows = [(0, [1.0, 0.0], 1), (1, [math.cos(angle * (1 + 1e-9)), math.sin(angle * (1 + 1e-9))], 1), (2, [math.cos(angle * (1 - 1e-9)), -math.sin(angle * (1 - 1e-9))], 1)]
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_labels_of_any_type_and_rows_without_id(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(3, v, "a", "x"), (1, v, "a", "x"), (1, v, "a", "x"), (2, v, "b", "x"), (None, v, "a", "x"), (5, w, None, "x"), (6, w, "", "x"), (7, w, "", "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, cell string").withColumn("component", F.lit("y")).withColumn("n_links", F.lit("z"))
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 3, 1), (5, 0, 5), (6, 1, 6), (7, 1, 6)]


def test_language_sample_of_one_frequent_id(spark):
    rows = [(None if i % 2 else 7, f"alpha beta gamma {i % 40}" if i % 3 else "copied words of alpha", "p") for i in range(6000)] + [(i, f"uno dos tres {i}", "q") for i in range(40)]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_texts=20)
    assert models.languages == ["p", "q"] and models.predict(pa.array(["beta alpha", "dos uno"]))[0] == ["p", "q"]


def test_pipeline_stages_on_edge_cases(spark):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the quick brown fox number{i} jumps over lazy dogs and cats", "en", "s", 5) for i in range(30)] + [(40, None, "en", "s", 0), (41, "", "en", "s", 0), (42, "12 34", None, None, None), (None, "the lazy dog jumps over", "en", "s", 1), (7, "the quick brown fox number7 jumps over lazy dogs and cats", "en", "s", 5)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        kept = df
        for name, stage in cp.STAGES:
            kept = cp.stored(stage(spark, kept, "unused"), "test")
            if name != "packing":
                assert kept.columns == df.columns
            if name == "language_id":
                assert not {40, 41, 42} & {r["doc_id"] for r in kept.collect()}
        assert bool(kept.count()) == bool(df.count())
    with pytest.raises(ValueError):
        cp.keep_identified(spark, spark.createDataFrame([(1, "some text", None, None, 9)], schema), "unused")


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
