"""Sum-of-squares online packing of tokenised documents into fixed windows.

Documents arrive one by one. ``levels[h]`` counts the partially filled windows that hold h
tokens; a document goes where the sum of the squared counts grows least: into a window of some
level, or into a new one. A document longer than a window first gives off full windows; only its
rest is placed. When a partition ends, or more than ``max_open`` windows are open (equal rests
that never complete one another, say), the open windows are joined: the emptiest are cut to fill
the fullest. A last incomplete window is cut at powers of two, at which sequences need no padding.

Every partition packs its own documents as it tokenises them: no shuffle, no driver state, and
memory bounded by ``max_open`` windows. A lost task is run again from its input.

Defined cases: a null or empty text is one piece that holds only the end id; a null id stays
null; repeated rows are packed as often as they come; no rows give no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from storyweft.llm.words import ids_by_word, split_by_bytes

WINDOW = 4096
END_ID = 2
#: Open windows kept by one packer before they are joined.
MAX_OPEN = 1024


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, each distinct word of a slice encoded once.

    This tokenizer lower-cases, drops white space and never joins tokens across it, so words
    between spaces are independent; so are a letter and the comma or full stop behind it. The words
    of the last slices are kept, in two generations of at most ``size`` words and one slice each.
    """

    def __init__(self, file: str, size: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.size = size
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words met for the first time: words of Latin letters together, as one text, all others one by one."""
        plain = [w for w in words if w.isalpha() and max(w) < "\u0250" and "\u0130" not in w]
        for k in range(0, len(plain), 10_000):
            part = plain[k : k + 10_000]
            ids = self._encoded([" ".join(part)])[0]
            cuts = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)  # each of these words is one run of letters
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                yield word, raw[start:end]
                start = end
        known = set(plain)
        others = [w for w in words if w not in known]
        for k in range(0, len(others), 10_000):
            part = others[k : k + 10_000]
            yield from zip(part, (ids.tobytes() for ids in self._encoded(part)), strict=True)

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known, old = self.known, self.old
        missing = [w for w in words if w not in known]
        known.update((w, old[w]) for w in missing if w in old)
        known.update(self._new([w for w in missing if w not in old]))
        out = list(map(known.__getitem__, words))
        if len(known) > self.size:
            self.known, self.old = {}, known
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts' ids; null texts have none."""
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else a special token could appear by lower-casing
            texts = pc.ascii_lower(texts)
            texts = pc.replace_substring_regex(texts, "([a-zß-öø-ÿ])([,.])", r"\1 \2")
        return ids_by_word(pc.replace_substring(texts, "\n", " "), self.lookup)


class SumOfSquares:
    """Packer of one stream of documents; a piece is (document, start, ids)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.windows: dict[int, list[list]] = {}  # the open ones by level
        self.open = 0
        self.done: list[list] = []  # complete sequences: lists of pieces

    def add(self, document: tuple, ids: bytes) -> None:
        whole = len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self.done.append([(document, start, ids[4 * start : 4 * (start + self.window)])])
        if rest := len(ids) // 4 - whole:
            self._place((document, whole, ids[4 * whole :]), rest)
        if self.open > self.max_open:
            self.join()

    def _place(self, piece: tuple, size: int) -> None:
        n, room = self.levels, self.window - size
        level, cost = 0, 2 * n[size] + 1
        at = np.flatnonzero(n[1 : room + 1]) + 1
        if at.size:
            costs = 2 * (n[at + size] - n[at]) + 2
            if at[-1] == room:  # that window would be complete and leave the counts
                costs[-1] = 1 - 2 * n[room]
            best = at.size - 1 - int(np.argmin(costs[::-1]))  # of equals the fullest
            if costs[best] <= cost:
                level = int(at[best])
        pieces = []
        if level:
            pieces = self.windows[level].pop()
            n[level] -= 1
            self.open -= 1
        pieces.append(piece)
        if level + size == self.window:
            self.done.append(pieces)
        else:
            n[level + size] += 1
            self.windows.setdefault(level + size, []).append(pieces)
            self.open += 1

    def join(self) -> None:
        """Complete all open windows but one by cutting the emptiest."""
        held = [[level, pieces] for level in sorted(self.windows) for pieces in self.windows[level]]
        self.levels[:] = 0
        self.windows, self.open = {}, 0
        low, high = 0, len(held) - 1
        while low < high:
            moved = min(self.window - held[high][0], held[low][0])
            held[high][1].extend(self._taken(held[low][1], moved))
            held[high][0] += moved
            held[low][0] -= moved
            if held[high][0] == self.window:
                self.done.append(held[high][1])
                high -= 1
            if not held[low][0]:
                low += 1
        if low == high:
            level, pieces = held[low]
            self.levels[level] = 1
            self.windows[level] = [pieces]
            self.open = 1

    @staticmethod
    def _taken(pieces: list[tuple], n: int) -> list[tuple]:
        """Take n tokens off the end of a window's pieces."""
        out = []
        while n:
            document, start, ids = pieces.pop()
            kept = max(0, len(ids) // 4 - n)
            if kept:
                pieces.append((document, start, ids[: 4 * kept]))
            out.append((document, start + kept, ids[4 * kept :]))
            n -= len(ids) // 4 - kept
        return out

    def finish(self) -> None:
        """Complete everything; the last tokens become sequences whose lengths are powers of two."""
        self.join()
        for level, held in self.windows.items():
            sizes = [1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1]
            self._cut(held[0], sizes)
        self.levels[:] = 0
        self.windows, self.open = {}, 0

    def _cut(self, pieces: list[tuple], sizes: list[int]) -> None:
        """Cut a row of pieces into complete sequences of the given sizes."""
        left = iter(sizes)
        sequence, room = [], next(left)
        for document, start, ids in pieces:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                sequence.append((document, start, part))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    self.done.append(sequence)
                    sequence, room = [], next(left, 0)


_LOADED: dict[str, WordTokenizer] = {}


def loaded(file: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if file not in _LOADED:
        _LOADED[file] = WordTokenizer(file)
    return _LOADED[file]


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece: document, start in it, length, CRC-32 of the ids, the document's tokens, sequence, offset there, ids."""
    kinds = {id_col: pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    if keep_ids:
        kinds["ids"] = pa.binary()
    schema = pa.schema(kinds.items())
    names = {pa.int64(): "long", pa.binary(): "binary"}
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = loaded(tokenizer_file), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 40

        def emitted() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in packer.done:
                offset = 0
                for (doc, tokens), start, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), tokens, sequence, offset, ids)[: len(schema)])
                    offset += n
                sequence += 1
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

        for whole in batches:
            for batch in split_by_bytes(whole, 1, 2_000_000):
                ids, at = tokenizer.encode(batch.column(1))
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    own = ids[at[k] : at[k + 1]].tobytes() + end
                    packer.add((doc, len(own) // 4), own)
                yield emitted()
        packer.finish()
        yield emitted()

    return docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{f.name} {names[f.type]}" for f in schema))
