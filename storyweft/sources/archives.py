"""Archives of captured feeds and pages as Spark data sources, in batch and as streams.

A plugin is a subclass of :class:`Archive`: it names its format and columns and says how a file's bytes
become rows. ``register(spark)`` makes every plugin known, those of other modules too once they are
imported; then ``spark.read.format("page_archive").load(folder)`` and ``spark.readStream`` read it.

Files are listed and opened through Arrow's file systems, so a folder is any URI that these know. A
partition is a run of files of bounded size. A stream's offset is the modification time and path of the
last file that was read, so a restarted query goes on behind it; files that appear later with an earlier time are not seen.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of the files of a partition; a larger file is one alone.
PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def _listed(folder: str) -> list[tuple[int, str, int]]:
    """(modification time in ns, path, size) of a folder's files, in that order; hidden ones are left out."""
    files, path = _system(folder)
    selector = pyarrow.fs.FileSelector(path, recursive=True, allow_not_found=True)
    found = [(f.mtime_ns or 0, f.path, f.size) for f in files.get_file_info(selector) if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted(found)


def _system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _runs(listed: list[tuple[int, str, int]]) -> list[Files]:
    out: list[Files] = []
    held = 0
    for _, path, size in listed:
        if not out or held + size > PARTITION_BYTES:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def _rows(archive: Archive, folder: str, partition: Files) -> Iterator[tuple]:
    files, _ = _system(folder)
    for path in partition.paths:
        with files.open_input_stream(path, compression=None) as stream:
            data = stream.read()
        yield from archive.parse(path, gzip.decompress(data) if path.endswith(".gz") else data)


class _Reader(DataSourceReader):
    def __init__(self, archive: Archive, folder: str):
        self.archive, self.folder = archive, folder

    def partitions(self) -> list[Files]:
        return _runs(_listed(self.folder))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.archive, self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, archive: Archive, folder: str):
        self.archive, self.folder = archive, folder

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        listed = _listed(self.folder)
        return {"time": listed[-1][0], "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _runs([f for f in _listed(self.folder) if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.archive, self.folder, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Archive(DataSource):
    """Base of the plugins: ``kind`` is the format's name, ``columns`` its schema, ``parse`` gives the rows of a file."""

    kind = ""
    columns = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return self.columns

    def parse(self, path: str, data: bytes) -> Iterator[tuple]:
        raise NotImplementedError

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError(f"{self.kind} needs a folder")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self, self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self, self._folder())


class FeedArchive(Archive):
    """Captured feeds, a document each: its path and XML, ready for ``parse_feed_items``; bytes that aren't UTF-8 are replaced."""

    kind = "feed_archive"
    columns = "feed_id string, xml string"

    def parse(self, path: str, data: bytes) -> Iterator[tuple]:
        yield path, data.decode(errors="replace")


class PageArchive(Archive):
    """Captured pages as JSON lines (page_id, url, html); a line that is no such object is left out."""

    kind = "page_archive"
    columns = "page_id long, url string, html string"

    def parse(self, path: str, data: bytes) -> Iterator[tuple]:
        for line in data.decode(errors="replace").split("\n"):
            try:
                page = json.loads(line)
                yield int(page["page_id"]), page.get("url"), page.get("html")
            except (ValueError, TypeError, KeyError, AttributeError):
                continue


class ThresholdArchive(Archive):
    """Alert thresholds as JSON lines (dimension, limit), read anew by every micro-batch that joins them."""

    kind = "alert_thresholds"
    columns = "dimension string, limit double"

    def parse(self, path: str, data: bytes) -> Iterator[tuple]:
        for line in filter(str.strip, data.decode().split("\n")):
            row = json.loads(line)
            yield row["dimension"], float(row["limit"])


def plugins(base: type[Archive] = Archive) -> dict[str, type[Archive]]:
    """All plugins that are imported, by the names of their formats."""
    out = {}
    for cls in base.__subclasses__():
        if cls.kind:
            out[cls.kind] = cls
        out |= plugins(cls)
    return out


def register(spark: SparkSession) -> list[str]:
    """Make all plugins known to a session; returns their names."""
    found = plugins()
    for cls in found.values():
        spark.dataSource.register(cls)
    return sorted(found)
