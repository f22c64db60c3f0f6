"""Token ids of documents in bit-packed files, in ascending order of document id.

A file holds every id in the fewest bits that its vocabulary needs. Ids lie in blocks of a fixed
number of ids; eight ids fill as many whole bytes as an id has bits, so a block starts on a byte and
numpy packs and unpacks eight lanes at a time. The footer lists the documents (id and end, counted in
ids) and every block's byte offset, so any range of ids is read by decoding only the blocks that it touches.

Layout, little-endian: magic, ``bits`` and ``block`` (u32 each) | blocks | footer: presence of each
document id (u8), document ids (i64), ends (u64), block offsets (u64, one more than blocks) | number of
documents, number of ids, footer's offset (u64 each), magic.

Texts are range-partitioned by document id, and each task encodes its range straight into files of
bounded size, so no ids are kept besides them. Where a file starts among all ids follows from the files'
counts. A file is written by one task under a name of its own; the index names
only files of finished tasks, so a lost executor leaves at most a file that nothing refers to.

Defined cases: a null or empty text is the end id alone; documents without id come first; rows that
repeat an id follow one another by their texts' checksums and may be split over files; an empty table gives no
file and no rows. Only id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.llm.packing import loaded
from storyweft.llm.storage import shared_folder
from storyweft.llm.words import split_by_bytes

MAGIC = b"SWTOKEN1"
END_ID = 2
#: Ids of a block, a multiple of eight.
BLOCK = 4096
#: A file is closed when it holds as many ids.
FILE_IDS = 1 << 27
#: Blocks unpacked at once when a whole file is read.
READ_BLOCKS = 128

_HEAD, _TAIL = struct.Struct("<8sII"), struct.Struct("<QQQ8s")
_FILE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell so many ids apart."""
    if not 1 <= vocabulary <= 1 << 32:
        raise ValueError("a vocabulary holds 1 to 2**32 ids")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = np.zeros((-(-ids.size // 8), 8), np.uint64)
    lanes.reshape(-1)[: ids.size] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, first + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: (ids.size * bits + 7) // 8]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    rows = -(-count // 8)
    raw = np.zeros(rows * bits, np.uint8)
    held = np.frombuffer(data, np.uint8)[: rows * bits]
    raw[: held.size] = held
    raw = raw.reshape(rows, bits)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        value = np.zeros(rows, np.uint64)
        for k in range((shift + bits + 7) // 8):
            value |= raw[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class TokenWriter:
    """Writes one file, block by block; memory holds the documents' table and less than one chunk of ids."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block is a multiple of eight ids")
        self.uri, self.bits, self.block = uri, bits, block
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        self.out.write(_HEAD.pack(MAGIC, bits, block))
        self.at = _HEAD.size
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.n_ids = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Append a document; ids may be of any unsigned type."""
        self.waiting.append(ids)
        self.held += ids.size
        self.n_ids += ids.size
        self.docs.append(doc)
        self.ends.append(self.n_ids)
        if self.held >= READ_BLOCKS * self.block:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = ids.size if last else ids.size // self.block * self.block
        size = self.block * self.bits // 8
        packed = pack(ids[:whole], self.bits)
        self.offsets += range(self.at, self.at + len(packed), size)
        self.out.write(packed)
        self.at += len(packed)
        self.waiting, self.held = [ids[whole:]], ids.size - whole

    def close(self) -> tuple:
        """(uri, smallest id, largest id, documents, ids) of the file."""
        self._write(True)
        self.offsets.append(self.at)
        known = np.array([d is not None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        for part in (known, docs, np.array(self.ends, "<u8"), np.array(self.offsets, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(len(self.docs), self.n_ids, self.at, MAGIC))
        self.out.close()
        held = docs[known > 0]
        return self.uri, int(held[0]) if held.size else None, int(held[-1]) if held.size else None, len(self.docs), self.n_ids


class TokenReader:
    """Reads any range of ids, or any document, of one file."""

    def __init__(self, uri: str):
        files, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        magic, self.bits, self.block = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        end = self.file.size() - _TAIL.size
        n, self.n_ids, footer, again = _TAIL.unpack(self.file.read_at(_TAIL.size, end))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{uri} is no token file")
        table = self.file.read_at(end - footer, footer)
        self.known = np.frombuffer(table, np.uint8, n)
        self.docs = np.frombuffer(table, "<i8", n, n)
        self.ends = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(table, "<u8", offset=17 * n).astype(np.int64)
        if self.offsets.size != -(-self.n_ids // self.block) + 1:
            raise ValueError(f"{uri} is damaged")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``, of which only the blocks that hold them are read."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"ids {start} to {stop} of {self.n_ids}")
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        data = self.file.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        count = min(last * self.block, self.n_ids) - first * self.block
        return unpack(data, count, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, doc: int) -> list[np.ndarray]:
        """Ids of the documents of one id; those with an id are in ascending order behind those without."""
        without = int((self.known == 0).sum())
        low, high = (without + int(np.searchsorted(self.docs[without:], doc, side)) for side in ("left", "right"))
        return [self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k])) for k in range(low, high)]

    def documents(self) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first, last, pieces) of runs of documents: each one's ids as unsigned 32-bit integers; a long one is put together from its chunks."""
        step, k, open_piece = READ_BLOCKS * self.block, 0, []
        for start in range(0, self.n_ids, step):
            stop = min(start + step, self.n_ids)
            raw = self.ids(start, stop).astype("<u4").tobytes()
            last = int(np.searchsorted(self.ends, stop, side="right"))
            cuts = [0, *(4 * (self.ends[k:last] - start)).tolist()]
            pieces = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if pieces and open_piece:
                pieces[0] = b"".join(open_piece) + pieces[0]
                open_piece = []
            open_piece.append(raw[cuts[-1] :])
            yield k, last, pieces
            k = last

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all documents into files of about ``file_ids`` ids below a shared folder; returns their index.

    The index has one row per file: part, seq, uri, first_id, last_id, n_docs, n_ids, and ``start``, the ids of all files before it.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    bits = bits_for(len(loaded(tokenizer_file).ends_word))
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, rows, tokenizer = TaskContext.get().partitionId(), None, [], loaded(tokenizer_file)
        for whole in batches:
            for batch in split_by_bytes(whole, 1, 2_000_000):
                ids, at = tokenizer.encode(batch.column(1))
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    if writer is None:
                        writer = TokenWriter(f"{folder}/tokens/{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.bin", bits)
                    writer.add(doc, np.concatenate((ids[at[k] : at[k + 1]], end)))
                    if writer.n_ids >= file_ids:
                        rows.append((part, len(rows), *writer.close()))
                        writer = None
        if writer is not None:
            rows.append((part, len(rows), *writer.close()))
        if rows:
            yield _batch(list(zip(*rows, strict=True)), _FILE)

    # The row's number lets rows that repeat an id and text be split over tasks.
    order = ["id", "checksum", "row"]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.crc32(F.col(text_col).cast("binary")).alias("checksum"), F.monotonically_increasing_id().alias("row"))
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    ordered.mapInArrow(run, _ddl(_FILE)).write.parquet(f"{folder}/index")
    return read_index(docs.sparkSession, folder)


def read_index(spark, folder: str) -> DataFrame:
    """The index of written files, with ``start``."""
    files = spark.read.schema(_ddl(_FILE)).parquet(f"{folder}/index")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the shuffle that wrote the files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return files.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside")


def read_token_files(index: DataFrame, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Every document of the files of an index: id, start among all ids, n_tokens, ids_crc32, and ids (unsigned 32-bit)."""
    schema = _READ if keep_ids else pa.schema(list(_READ)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = TokenReader(uri)
                starts = start + np.concatenate(([0], reader.ends[:-1]))
                for first, last, pieces in reader.documents():
                    known = reader.known[first:last] == 0
                    columns = [pa.array(reader.docs[first:last], mask=known), starts[first:last], [len(p) // 4 for p in pieces], [zlib.crc32(p) for p in pieces], pieces]
                    yield _batch(columns[: len(schema)], schema)
                reader.close()

    # A file is one row here: dealt out one by one, as each is up to some hundred megabytes of ids.
    dealt = index.select("uri", "start").repartition("uri")
    return dealt.mapInArrow(run, _ddl(schema)).withColumnRenamed("id", id_col)


def read_document(index: DataFrame, doc: int) -> list[np.ndarray]:
    """Ids of the documents of one id, of which only the blocks that hold them are read."""
    out = []
    for hit in index.filter((F.col("first_id") <= doc) & (F.col("last_id") >= doc)).orderBy("part", "seq").collect():
        reader = TokenReader(hit["uri"])
        out += reader.document(doc)
        reader.close()
    return out
