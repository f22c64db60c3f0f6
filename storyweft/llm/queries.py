"""One thin query for each corpus operator: ``(spark, sf_dir) -> DataFrame`` over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm import dual_tree, embedding_dedup, gru_lm, hilbert, jaccard_join, langid, merkle, packing, pii, sentencepiece_bpe, sharding, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(divisor: int) -> Column:
    """Remainder of the CRC-32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 40)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records into seekable bundles, and read back from them."""
    index = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, payloads=False)


def op3_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every text, learned from the documents outside fold 2 of 7."""
    return gru_lm.score_documents(_table(spark, sf_dir, "documents"), _fold(7) != 2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside fold 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    models = langid.train(docs.filter(_fold(4) != 2))
    return langid.identify(docs, models).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with begin and end ids, and decoded again."""
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered spans of personal data in every text."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn_patterns(docs))
    counts = [F.size(pii.of_kind(F.col("base"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return hilbert.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingle Jaccard similarity of 0.75 or more."""
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings with the same label by cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item among all."""
    return dual_tree.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; texts of ids with an even checksum are tampered with."""
    without_lines = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle.build(_table(spark, sf_dir, "documents"), tampered={"text": without_lines})
    return merkle.proofs(manifest, keep_proofs=False)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to bit-packed files, and read back from them."""
    index = token_files.write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(index, keep_ids=False)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_warc": op2_warc,
    "op3_gru_lm": op3_gru_lm,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_dual_tree_search": op11_dual_tree_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_files": op13_token_files,
}


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


#: Trees by recursion, level by level: ``n`` nodes of a tree, ``place`` a node's place; then each leaf's siblings, and its fold.
_MERKLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256({" || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, c: list_reduce(range(8), lambda h, bit: xor(h >> 1, 3988292384 * (h & 1)), xor(crc, c)), 4294967295) AS crc,
    {" || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars"))} AS head, text
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
    CASE WHEN (crc & 1) = 1 AND text IS NOT NULL THEN sha256(head || {_field("replace(text, chr(10), '')")}) ELSE leaf END AS own
  FROM docs),
low AS (
  SELECT source, 0 AS level, place, n, leaf AS hash FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY source, level, place // 3, n),
places AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, n, hash FROM places
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 3, n),
lows AS (
  SELECT me.source, me.level, me.place, coalesce(string_agg(it.hash, '' ORDER BY it.place) FILTER (it.place < me.place), '') AS before, coalesce(string_agg(it.hash, '' ORDER BY it.place) FILTER (it.place > me.place), '') AS after
  FROM low AS me JOIN low AS it ON it.source IS NOT DISTINCT FROM me.source AND it.level = me.level AND it.place // 3 = me.place // 3 WHERE me.n > 1 GROUP BY ALL),
highs AS (
  SELECT me.level, me.place, coalesce(string_agg(it.hash, '' ORDER BY it.place) FILTER (it.place < me.place), '') AS before, coalesce(string_agg(it.hash, '' ORDER BY it.place) FILTER (it.place > me.place), '') AS after
  FROM high AS me JOIN high AS it ON it.level = me.level AND it.place // 3 = me.place // 3 WHERE me.n > 1 GROUP BY ALL),
below AS (
  SELECT doc_id, source, place AS first, 0 AS level, place, own AS hash, '' AS proof FROM placed
  UNION ALL
  SELECT b.doc_id, b.source, b.first, b.level + 1, b.place // 3, sha256(before || b.hash || after), proof || before || after FROM below AS b JOIN lows AS s ON s.source IS NOT DISTINCT FROM b.source AND s.level = b.level AND s.place = b.place),
through AS (
  SELECT b.doc_id, b.source, b.first, 0 AS level, p.place, b.hash, b.proof
  FROM below AS b JOIN places AS p ON p.source IS NOT DISTINCT FROM b.source WHERE b.level = (SELECT max(level) FROM low AS l WHERE l.source IS NOT DISTINCT FROM b.source)
  UNION ALL
  SELECT t.doc_id, t.source, t.first, t.level + 1, t.place // 3, sha256(before || t.hash || after), proof || before || after FROM through AS t JOIN highs AS s ON s.level = t.level AND s.place = t.place)
SELECT t.doc_id, d.leaf, p.hash AS subroot, r.hash AS root, sha256(t.proof) AS proof_sha256, t.hash AS folded_root, t.hash = r.hash AS verified
FROM through AS t JOIN placed AS d ON d.source IS NOT DISTINCT FROM t.source AND d.place = t.first JOIN places AS p ON p.source IS NOT DISTINCT FROM t.source JOIN high AS r ON r.n = 1 AND r.level = t.level
"""

_TERMS = r"list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"

_SEARCH_SQL = f"""
WITH docs AS (SELECT * FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM docs),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counts AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS part FROM counts JOIN weights USING (term), corpus),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM items JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
"""

ORACLE_SQL: dict[str, str] = {"op11_dual_tree_search": _SEARCH_SQL, "op12_merkle_manifest": _MERKLE_SQL}
