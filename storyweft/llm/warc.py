"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames; a skippable frame at the end of each bundle
holds every frame's compressed and plain size, so any frame can be read alone. The index maps a
record to its bundle, frame and offset within the frame.

Records with equal payloads of at least ``least`` bytes are stored once: the one with the largest
id is the response, the others are revisits that name it. Counts of equal payloads are aggregated
by salted digests first, so a payload that a third of all pages share is no single task.

A bundle is written by one task under a name of its own; the index names only bundles of finished
tasks, so a lost executor leaves at most a file that nothing refers to.

Defined cases: a null payload is empty; a null URL is left out; a null id is stored without one and
never referred to unless all equal payloads lack ids, which are then all responses; rows that
repeat the largest id are all responses; an empty table gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.storage import shared_folder

#: Fixed values of the seekable format: magic of the skippable frame and of its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
#: A payload must be as long as this to be stored as a revisit.
REVISIT_BYTES = 1000
SALTS = 256
WARC_DATE = "1970-01-01T00:00:00Z"
_RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_SQL_TYPE = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL_TYPE[f.type]}" for f in schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORDS, str(page_id))}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (with ``refers_to``) leaves the payload out."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", WARC_DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    head += [("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[tuple, int]:
    """The row of the record that starts at a position, and where the next starts. Checks the payload's digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(head["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload, size = None, int(head["X-Payload-Length"])
    if head["WARC-Type"] == "response":
        payload = data[start + len(_HTTP) : start + length]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
    number = lambda name: int(head[name]) if name in head else None
    url = head.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return (number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page"), url, payload), start + length + 4


class BundleWriter:
    """Writes one bundle, frame by frame."""

    def __init__(self, uri: str):
        self.uri = uri
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.frame = bytearray()
        self.plain = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.sizes), len(self.frame)
        self.frame += record
        self.plain += len(record)
        return place

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.frame))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        table = b"".join(struct.pack("<II", *size) for size in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{uri} has no seek table of this kind")
        table = self.file.read_at(8 * frames, end - 9 - 8 * frames)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, plain = self.sizes[k]
        data = self.zstd.decompressobj().decompress(self.file.read_at(packed, self.starts[k]))
        if len(data) != plain:
            raise ValueError("a frame is damaged")
        return data

    def close(self) -> None:
        self.file.close()


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages as page_id, url, payload (binary), digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select("*", F.sha1("payload").alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    equal = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest", "salt")
        .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
        .filter(F.col("n") > 1)
        .select("digest", "top", F.explode("salts").alias("salt"))
    )
    return rows.join(equal, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records; returns the index, stored beside the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: BundleWriter | None = None
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or writer.plain > BUNDLE_BYTES:
                    if writer is not None:
                        writer.close()
                    writer = BundleWriter(f"{folder}/bundles/{uuid.uuid4().hex}.warc.zst")
                record = format_record(page_id, url, payload, digest, refers_to)
                index.append((page_id, writer.uri, *writer.add(record), len(record)))
            yield _batch(index, _INDEX)
        if writer is not None:
            writer.close()

    records.mapInArrow(run, _ddl(_INDEX)).write.parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles in an index, a frame at a time; each frame is read by one task, whichever."""
    schema = _READ if payloads else pa.schema(list(_READ)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, reader = None, None
        for batch in batches:
            for bundle, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bundle != uri:
                    if reader is not None:
                        reader.close()
                    uri, reader = bundle, BundleReader(bundle)
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    row, at = parse_record(data, at)
                    rows.append(row[: len(schema)])
                yield _batch(rows, schema)
        if reader is not None:
            reader.close()

    return index.select("bundle", "frame").distinct().mapInArrow(run, _ddl(schema))


def read_record(index: DataFrame, page_id: int) -> list[tuple]:
    """Rows of the records of one id, each by one seek into its frame."""
    out = []
    for hit in index.filter(F.col("page_id") == page_id).collect():
        reader = BundleReader(hit["bundle"])
        out.append(parse_record(reader.frame(hit["frame"]), hit["offset"])[0])
        reader.close()
    return out


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages into bundles below a shared folder; returns the index."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    return write_bundles(plan_records(pages), folder)
