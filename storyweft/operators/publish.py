"""Exports, evidence and publication documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "narrative_id"


def evidence(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the SHA-256 of their canonical JSON (sorted column names)."""
    body = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})
    return rows.withColumn("body", body).withColumn("evidence_hash", F.sha2(F.col("body"), 256))


def write_evidence(rows: DataFrame, path: str) -> None:
    """Content-addressed JSON files, partitioned by the first two digits of the hash."""
    rows.select(F.substring("evidence_hash", 1, 2).alias("prefix"), "evidence_hash", "body").write.partitionBy("prefix").json(path)


def verify_evidence(rows: DataFrame) -> DataFrame:
    """Whether each stored body still has its hash."""
    return rows.withColumn("valid", F.sha2(F.col("body"), 256) == F.col("evidence_hash"))


def pending_evidence(rows: DataFrame) -> DataFrame:
    """Instances with a narrative that have no evidence yet, and all, in one row."""
    return rows.agg(F.count_if(F.col("evidence_hash").isNull() & F.col(KEY).isNotNull()).alias("pending"), F.count(F.lit(1)).alias("total"))


def trends_report(narratives: DataFrame, wide: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per narrative with its scores, the latest update first."""
    return narratives.select(KEY, "status", "last_updated").join(wide, KEY).select(KEY, "status", "last_updated", *dimensions).orderBy(F.desc("last_updated"), KEY)


def long_report(narratives: DataFrame, fields: list[str]) -> DataFrame:
    """Section, field and value rows."""
    return narratives.select(KEY, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot([KEY], fields, "field", "value").withColumn("section", F.lit("overview"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link JSON: one row per node and edge, written as JSON lines."""
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("node").alias("id"))).alias("json"))
    return a.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("a").alias("source"), F.col("b").alias("target"))).alias("json")))


def bundle(heads: DataFrame, parts: DataFrame, key: str, name: str, most: int) -> DataFrame:
    """Documents (JSON) of heads with up to ``most`` of their parts, by part id."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy("part_id"))
    first = parts.withColumn("place", place).filter(F.col("place") <= most)
    nested = first.groupBy(key).agg(F.sort_array(F.collect_list("part_id")).alias(name))
    joined = heads.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
    return joined.select(key, F.to_json(F.struct(*sorted(joined.columns))).alias("document"))


def evidence_bundle(records: DataFrame) -> DataFrame:
    """Publication documents (JSON) of evidence records: record_id, content_hash, source_url, captured, content_type, verified, verification_method, metadata (JSON), content_data.

    Missing fields are written as null; the content itself only where there is some; metadata that is no JSON object is empty.
    """
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    fields = [
        F.lit("evidence_record").alias("type"), F.concat(F.lit("evidence-"), "record_id").alias("id"), F.col("content_hash").alias("hash"), "source_url",
        F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss").alias("capture_date"), "content_type", "verified", "verification_method", meta.alias("metadata"), F.lit("1.0").alias("version"),
    ]
    keep = {"ignoreNullFields": "false"}
    document = F.when(F.coalesce(F.col("content_data"), F.lit("")) == "", F.to_json(F.struct(*fields), keep)).otherwise(F.to_json(F.struct(*fields, "content_data"), keep))
    return records.select("record_id", document.alias("document"))


def content_catalog(publications: DataFrame) -> DataFrame:
    """Latest publication of each content."""
    return publications.groupBy("content_id").agg(F.max_by("hash", "at").alias("hash"), F.max("at").alias("at"))


def candidate_feed_urls(urls: DataFrame, paths: tuple[str, ...] = ("/feed", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml")) -> DataFrame:
    """Base of each URL with common feed paths, without the URL itself."""
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return urls.select("url", F.explode(F.array(*(F.concat(base, F.lit(p)) for p in paths))).alias("candidate")).filter(F.col("candidate") != F.col("url")).distinct()


def apply_status_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change of each key, guarded: only drafts are approved."""
    latest = changes.groupBy("id").agg(F.max_by("new_status", "at").alias("new_status"))
    allowed = (F.col("new_status") != "approved") | (F.col("status") == "draft")
    return rows.join(latest, "id", "left").select("id", F.when(F.col("new_status").isNotNull() & allowed, F.col("new_status")).otherwise(F.col("status")).alias("status"))


def edit_feed_list(sources: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """Feed lists of the configurations after changes, without repetitions, as JSON."""
    schema = "feeds array<string>, category string"
    parsed = sources.withColumn("c", F.from_json("config", schema))
    feeds = F.array_except(F.array_union(F.coalesce("c.feeds", F.array().cast("array<string>")), F.array(*map(F.lit, add))), F.array(*map(F.lit, remove)))
    return parsed.select("source_id", F.to_json(F.struct(feeds.alias("feeds"), F.col("c.category").alias("category"))).alias("config"))
