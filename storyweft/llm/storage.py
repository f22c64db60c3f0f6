"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of a local session that has no setting.
_OWN: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """URI of a new folder name below ``spark.checkpoint.dir``; where a local session hasn't set it, below a temporary one.

    On a cluster a temporary folder would be another one on each machine, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='storyweft-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: its lineage ends there, and a lost executor takes nothing with it."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
