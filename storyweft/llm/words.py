"""Vectorised word and shingle kernels over Arrow string columns.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. UTF-8 keeps
every byte of a multi-byte character above 0x7F, so working on bytes equals working on
code points. A word is identified by a 64-bit hash, and a shingle by a hash of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSITIONS = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _letter_codes(cells: np.ndarray) -> np.ndarray:
    """A code for each (position << 8 | byte)."""
    return mix((cells.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_CODES = _letter_codes(np.arange(_POSITIONS << 8))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null and empty texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; no word crosses a row's end."""
    inside = ~_SEPARATOR[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = np.zeros(raw.size + 1, bool)
    ends[1:-1] = inside[:-1] & ~inside[1:]
    if raw.size:
        ends[raw.size] = inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < raw.size)]
    both = cut[inside[cut] & inside[cut - 1]]
    starts[both] = True
    ends[both] = True
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    row = np.searchsorted(offsets, begin, side="right") - 1
    return begin, end, row


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, lower-cased A-Z: the mixed sum of one code for each byte and its place in the word.

    The codes of different places are unrelated, so no rearrangement of a word's bytes keeps its sum.
    """
    if begin.size == 0:
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    letters = _LOWER[raw]
    letters = letters[~_SEPARATOR[raw]]  # those of the words, one after another
    cells = np.arange(letters.size, dtype=np.int64) - np.repeat(first, size)
    cells <<= 8
    cells |= letters
    codes = _CODES.take(cells, mode="clip")
    if size.max() > _POSITIONS:
        far = np.flatnonzero(cells >= _CODES.size)
        codes[far] = _letter_codes(cells[far])
    return mix(np.add.reduceat(codes, first) + size.astype(np.uint64))


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingle hashes in ascending order.

    A text with fewer words than ``size`` has its whole word sequence as one shingle; one
    without words has none.
    """
    raw, offsets = string_buffers(column)
    n = len(offsets) - 1
    begin, end, row = word_spans(raw, offsets)
    h = word_hashes(raw, begin, end)
    counts = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    total = int(made.sum())
    owner = np.repeat(np.arange(n), made)
    start = np.arange(total) - np.repeat(np.cumsum(made) - made, made) + first[owner]
    span = np.minimum(counts[owner], size)
    value = span.astype(np.uint64)
    for k in range(size):
        here = k < span
        word = h[np.minimum(start + k, max(h.size - 1, 0))] if h.size else np.zeros(total, np.uint64)
        value = np.where(here, value * np.uint64(0xD6E8FEB86659FD93) + word, value)
    value = mix(value)
    ends = np.cumsum(made)
    for first_at, last_at in zip(ends - made, ends, strict=True):
        value[first_at:last_at].sort()
    keep = np.ones(total, bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def split_by_bytes(batch: pa.RecordBatch, column: int, limit: int = 6_000_000) -> list[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes each; a longer text stands alone."""
    _, offsets = string_buffers(batch.column(column))
    out, first = [], 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        out.append(batch.slice(first, last - first))
        first = last
    return out


def ids_by_word(texts: pa.Array, lookup: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each text's ids, from those of its words between single spaces.

    ``lookup`` maps distinct words to little-endian unsigned 32-bit ids; it sees each word of these
    texts once.
    """
    lists = pc.split_pattern(texts, " ")
    at = lists.offsets.to_numpy()
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    parts = lookup(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(sizes) - sizes
    pool = np.frombuffer(b"".join(parts), "<u4")
    word = coded.indices.to_numpy()
    n = sizes[word]
    ends = np.concatenate(([0], np.cumsum(n)))
    ids = pool[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], n)]
    return ids, ends[at - at[0]]
