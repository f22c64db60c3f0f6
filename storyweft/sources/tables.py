"""Typed scans of the entity tables, and the views of the supplied tables that stand in for them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.functions.numbers import rounded

#: Operators never ask for the current time; look-backs end here.
AS_OF = "2024-01-31"
FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-30"
DIMENSIONS = ("overall", "linguistic", "logical", "rhetorical", "emotional")
#: Event types in the order of the complexity dimensions that they stand for.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one entity table; filters and column choices reach the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables:
    """The logical tables over one folder. Each is lazy, and reads only the columns it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @cached_property
    def instances(self) -> DataFrame:
        """Posts: instance_id, narrative_id, source_id, detected_at, platform, value."""
        key = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(F.col("event_id").alias("instance_id"), F.col("user_id").alias("narrative_id"), (key % 20 + 1).alias("source_id"), F.col("ts").cast("timestamp_ntz").alias("detected_at"), F.col("event_type").alias("platform"), "value")

    @cached_property
    def misinfo_events(self) -> DataFrame:
        """Instances that were events of misinformation; a third are judged correct, a third wrong, the rest not yet."""
        judged = F.when(F.col("instance_id") % 3 == 0, True).when(F.col("instance_id") % 3 == 1, False)
        return self.instances.filter("platform = 'error'").withColumn("correct_detection", judged)

    @cached_property
    def daily(self) -> DataFrame:
        """narrative_id, day, n: zero-filled daily counts."""
        from storyweft.operators.series import daily_counts

        return daily_counts(self.instances, FIRST_DAY, LAST_DAY)

    @cached_property
    def snapshots(self) -> DataFrame:
        """narrative_id, day and five complexity scores from 0 to 10."""
        score = rounded(F.avg(F.least(F.lit(10.0), F.abs("value") / 10)))
        pivoted = self.instances.groupBy("narrative_id", F.to_date("detected_at").alias("day")).pivot("platform", list(EVENT_TYPES)).agg(score)
        return pivoted.select("narrative_id", "day", *(F.col(e).alias(d) for e, d in zip(EVENT_TYPES, DIMENSIONS, strict=True)))

    @cached_property
    def narratives(self) -> DataFrame:
        """Texts: narrative_id, title, description, language, source, status, first_detected, last_updated, threat_level, confidence_score."""
        n = F.col("doc_id")
        day = lambda k: F.date_add(F.lit(LAST_DAY).cast("date"), -(n % k).cast("int"))
        status = F.element_at(F.array(*map(F.lit, ("active", "confirmed", "debunked", "archived"))), (n % 4 + 1).cast("int"))
        return self.raw("documents").select(
            n.alias("narrative_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("description"), F.col("lang").alias("language"), "source",
            status.alias("status"), day(60).alias("first_detected"), day(30).alias("last_updated"), (n % 6).cast("int").alias("threat_level"), (n % 100 / 100).alias("confidence_score"),
        )

    @cached_property
    def sources(self) -> DataFrame:
        """Suppliers as sources: source_id, name, source_type, is_active, config."""
        n = F.col("s_suppkey")
        kind = F.element_at(F.array(*map(F.lit, ("rss", "twitter", "telegram", "web"))), (n % 4 + 1).cast("int"))
        config = F.format_string('{"feeds": ["https://feeds.example.org/%d/rss", "https://feeds.example.org/%d/atom"], "category": "c%d"}', n, n, n % 5)
        return self.raw("supplier").select(n.cast("long").alias("source_id"), F.col("s_name").alias("name"), kind.alias("source_type"), (n % 3 != 0).alias("is_active"), config.alias("config"))

    @cached_property
    def shares(self) -> DataFrame:
        """Bipartite graph of sources and narratives: source_id, narrative_id, detected_at."""
        return self.raw("lineitem").select(F.col("l_suppkey").cast("long").alias("source_id"), F.col("l_partkey").cast("long").alias("narrative_id"), F.col("l_shipdate").cast("date").alias("detected_at"))


#: The same views in DuckDB SQL, to stand before each query's own SQL.
SQL_VIEWS = f"""
WITH RECURSIVE instances AS (SELECT event_id AS instance_id, user_id AS narrative_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) % 20 + 1 AS source_id, ts AS detected_at, event_type AS platform, value FROM events),
misinfo_events AS (SELECT *, CASE instance_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS correct_detection FROM instances WHERE platform = 'error'),
days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT k.narrative_id, d.day, COALESCE(c.n, 0) AS n FROM (SELECT DISTINCT narrative_id FROM instances) k CROSS JOIN days d LEFT JOIN (SELECT narrative_id, CAST(detected_at AS DATE) AS day, COUNT(*) AS n FROM instances GROUP BY 1, 2) c ON c.narrative_id = k.narrative_id AND c.day = d.day),
series AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY day) - 1 AS i, COUNT(*) OVER (PARTITION BY narrative_id) AS len FROM daily),
snapshots AS (SELECT narrative_id, CAST(detected_at AS DATE) AS day, {", ".join(f"ROUND(AVG(LEAST(10.0, ABS(value) / 10)) FILTER (WHERE platform = '{e}'), 6) AS {d}" for e, d in zip(EVENT_TYPES, DIMENSIONS, strict=True))} FROM instances GROUP BY 1, 2),
scores AS (SELECT narrative_id, day, dimension, score FROM snapshots UNPIVOT (score FOR dimension IN ({", ".join(DIMENSIONS)}))),
narratives AS (SELECT doc_id AS narrative_id, substr(text, 1, 40) AS title, text AS description, lang AS language, source, ['active', 'confirmed', 'debunked', 'archived'][CAST(doc_id % 4 + 1 AS INT)] AS status, DATE '{LAST_DAY}' - CAST(doc_id % 60 AS INT) AS first_detected, DATE '{LAST_DAY}' - CAST(doc_id % 30 AS INT) AS last_updated, CAST(doc_id % 6 AS INT) AS threat_level, doc_id % 100 / 100 AS confidence_score FROM documents),
sources AS (SELECT CAST(s_suppkey AS BIGINT) AS source_id, s_name AS name, ['rss', 'twitter', 'telegram', 'web'][CAST(s_suppkey % 4 + 1 AS INT)] AS source_type, s_suppkey % 3 <> 0 AS is_active, format('{{{{"feeds": ["https://feeds.example.org/{{0}}/rss", "https://feeds.example.org/{{0}}/atom"], "category": "c{{1}}"}}}}', s_suppkey, s_suppkey % 5) AS config FROM supplier),
shares AS (SELECT CAST(l_suppkey AS BIGINT) AS source_id, CAST(l_partkey AS BIGINT) AS narrative_id, CAST(l_shipdate AS DATE) AS detected_at FROM lineitem)
"""
