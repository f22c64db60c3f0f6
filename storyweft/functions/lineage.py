"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a broadcast side, checked before it is sent.
MAX_BROADCAST = 64_000_000
#: A scan of less than so many bytes a core is dealt out anew before work that is heavy for each row.
LIGHT_SCAN = 64 << 20


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in ``spark.checkpoint.dir``; a temporary one is set only where a local session has none."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="storyweft-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The same rows on all cores, where the scan is so small that a file's row groups don't make enough tasks; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * LIGHT_SCAN else df


#: The folder of a local session that has no setting.
_OWN: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """URI of a new folder name below ``spark.checkpoint.dir``, which on a cluster must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='storyweft-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
