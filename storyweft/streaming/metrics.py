"""Rows, errors and duration of each cycle of all streaming queries, as rows of a table."""

from __future__ import annotations

import json
import threading
import time
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

CYCLE = "agent string, cycle long, rows long, errors long, seconds double"


class CycleListener(StreamingQueryListener):
    """Appends one JSON line for each micro-batch that had input, and one for each query that failed, to a folder.

    Listener events come to the driver one after another; each is a small file of its own, so nothing is rewritten.
    """

    def __init__(self, folder: str):
        self.folder, self.names, self.written = folder, {}, 0
        self.lock = threading.Lock()

    def _append(self, **row) -> None:
        files, path = pyarrow.fs.FileSystem.from_uri(f"{self.folder}/{uuid.uuid4().hex}.json")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(json.dumps(row).encode() + b"\n")
        with self.lock:
            self.written += 1

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self._append(agent=p.name or str(p.id), cycle=p.batchId, rows=p.numInputRows, errors=0, seconds=p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        """An idle trigger is no cycle."""

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._append(agent=self.names.get(str(event.id), str(event.id)), cycle=-1, rows=0, errors=1, seconds=0.0)

    def settle(self, cycles: int, seconds: float) -> None:
        """Wait until so many rows are written, or the time is over."""
        end = time.monotonic() + seconds
        while self.written < cycles and time.monotonic() < end:
            time.sleep(0.1)


def read_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """The cycles written so far, for ``run_metrics``."""
    return spark.read.schema(CYCLE).json(folder)
