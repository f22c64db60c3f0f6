"""Jump consistent hashing of stable keys to shards, in column expressions only.

A key walks through the shard counts at which it would move; a linear congruential generator,
seeded by the key, draws each next jump. The last jump below the number of shards is its shard, so
no ring table is kept, and one more shard takes from the others only what goes to it.

``slot`` numbers each shard's rows from 0 without gaps. Rows fall into a fixed number of buckets of
a shard by hash; bucket counts (shards x buckets rows, a bound that is independent of the data)
give each bucket's first slot, and rows are numbered within their bucket. So no shard is one task.

Defined cases: a null key is placed like key 0; a null text has no bytes and CRC-32 0; rows with
the same key share a shard and get different slots; an empty table gives no rows. Columns other
than key and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Multiplier of the generator that jump hashing is defined with (a fixed value).
MULTIPLIER = 2862933555777941757
#: Buckets of each shard for numbering its rows.
BUCKETS = 1024
#: What a row takes besides its text.
ROW_BYTES = 16

_LOW = (1 << 31) - 1


def _next_state(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2 ** 64 in limbs of 31 bits, as bigint products must not overflow."""
    c0, c1, c2 = (F.lit(c) for c in (MULTIPLIER & _LOW, MULTIPLIER >> 31 & _LOW, MULTIPLIER >> 62))
    low = F.lit(_LOW)
    k0 = k.bitwiseAND(low)
    k1 = F.shiftrightunsigned(k, 31).bitwiseAND(low)
    k2 = F.shiftrightunsigned(k, 62)
    p0 = k0 * c0 + F.lit(1)
    p1 = k0 * c1 + k1 * c0 + F.shiftrightunsigned(p0, 31)
    p2 = k0 * c2 + k1 * c1 + k2 * c0 + F.shiftrightunsigned(p1, 31)
    return p0.bitwiseAND(low).bitwiseOR(F.shiftleft(p1.bitwiseAND(low), 31)).bitwiseOR(F.shiftleft(p2.bitwiseAND(F.lit(3)), 62))


def jump_hash(key: Column, shards: int) -> Column:
    """Struct of ``shard`` among ``shards`` and ``grown_shard`` among one more."""
    if shards < 1:
        raise ValueError("there must be a shard")

    def jump(state: Column, _: Column) -> Column:
        k = _next_state(state["k"])
        target = state["next"].cast("double") + F.lit(1.0)
        following = F.floor(target * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + F.lit(1)).cast("double")))
        moved = F.struct(k.alias("k"), state["next"].alias("at"), following.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("k"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    # Each jump goes up by one at least, so as many steps as shards reach the end.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)
    grown = F.when(end["next"] == shards, F.lit(shards)).otherwise(end["at"].cast("int"))
    return F.struct(end["at"].cast("int").alias("shard"), grown.alias("grown_shard"))


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row: id, size, text_crc32, law, shard, slot and grown_shard.

    Texts are measured where they are read; only ids and numbers are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_hash(F.col(id_col), shards).alias("placed"),
    ).select(
        id_col,
        "size",
        "text_crc32",
        F.col("placed.shard").alias("shard"),
        F.col("placed.grown_shard").alias("grown_shard"),
        F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "bucket").orderBy(id_col, "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])  # shards x buckets rows at most
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows into one folder per shard; a narrow job, each task writes its rows of every shard."""
    docs.withColumn("shard", jump_hash(F.col(id_col), shards)["shard"]).write.partitionBy("shard").parquet(path)
