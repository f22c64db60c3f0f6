"""A corpus pipeline: language identification, near-duplicate removal, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; each result is written as Parquet to the shared folder and read again by the next. All
stages but the last return the columns of ``documents``. Rows are told apart by ``doc_id``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm import jaccard_join, langid, packing, pii
from storyweft.llm.storage import stored


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; the models learn from the documents' own labels.

    A null text, or one without a letter, goes; rows that repeat an id or text are judged alike; an empty
    table stays empty. Documents without a single label can't be judged, which is an error.
    """
    models = langid.train(docs)
    if not models.languages and not docs.isEmpty():
        raise ValueError("no labelled text to learn languages from")
    return langid.filter_identified(docs, models)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity component: the one with the smallest id.

    Texts without words are unlike all others and stay, as do rows without id; rows that repeat a kept id stay together.
    """
    groups = jaccard_join.similarity_components(docs)
    others = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(stored(others, "pipeline-others"), "doc_id", "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all personal data replaced by its kind; ``n_chars`` follows the text; a null text stays null."""
    return pii.mask_documents(docs, pii.learn_patterns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; a null or empty text is one end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Language models, similarity components and online packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
