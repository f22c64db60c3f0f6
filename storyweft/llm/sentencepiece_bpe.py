"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Among all ways to cut a string into pieces, byte-pair encoding yields the only one whose
neighbouring pieces are all *compatible*: encoding the two joined gives the two back. So every
prefix of a word has exactly one last piece: of the pieces that end there (found by an
Aho-Corasick automaton), the one compatible with the last piece of the prefix before it. The
table of last pieces is filled left to right, and the ids are read from its end backwards, in
time linear in the word, without a merge queue.

Pieces of the model hold the space mark only at their start, so words are independent and are
memoised. Merges within a run of spaces all have one score, so the compatibility of a run's pieces
with what follows them is decided by encoding the pair.

Defined cases: a null or empty text gives the begin and end ids alone; characters outside the
vocabulary fall back to byte pieces; repeated rows give repeated results; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from storyweft.llm.caches import WordCache
from storyweft.llm.words import split_by_bytes

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixTableBpe:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.pieces = pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = [len(p) for p in pieces]
        self.byte_id, self.ids, self.score = {}, {}, {}
        self.decoded: list[bytes] = [b""] * n
        for i, piece in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.decoded[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.decoded[i] = piece.replace(SPACE, " ").encode()
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model cross spaces")
        #: Rank of a piece's merge: smaller merges first. A single character has none.
        self.rank = {p: r for r, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p]))}
        self.parts: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in list(self.ids):
            if len(piece) > 1:
                halves = self._last_merge(piece)
                if halves is None:
                    continue  # no order of merges leads to it
                self.parts[piece] = halves
            self.automaton.add_word(piece, self.ids[piece])
        self.automaton.make_automaton()
        if not {",", "."} <= self.ids.keys():
            raise ValueError("the model has no piece for a comma or a full stop")
        self.pairs = WordCache(self._compatible, 400_000)
        self.words = WordCache(lambda word: self._word(SPACE + word, self.words, word), 400_000)
        self.segments = WordCache(lambda segment: self._word(segment, self.segments, segment), 50_000)

    def merge_order(self, text: str) -> list[str]:
        """Pieces by the plain rule: the best-scored neighbouring pair merges first, the leftmost of equals."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(symbols) and (joined := symbols[left] + symbols[right]) in self.ids:
                heapq.heappush(queue, (-self.score[joined], left, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, left, joined = heapq.heappop(queue)
            right = after[left]
            if symbols[left] is None or right >= len(symbols) or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s is not None]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece when it is encoded alone; None if it never forms."""
        if self.merge_order(piece) != [piece]:
            return None
        # Encoding without the whole piece leaves exactly the two parts that merged last.
        score = self.score.pop(piece)
        whole = self.ids.pop(piece)
        left, right = self.merge_order(piece)
        self.score[piece], self.ids[piece] = score, whole
        return left, right

    def _compatible(self, pair: int) -> bool:
        """Whether encoding the joined pair gives the pair back.

        Undo the merges of both sides, latest first, and look for a merge across the border that
        would have come before the one being undone; of equal ranks the leftmost comes first.
        """
        left, right = self.pieces[pair >> 32], self.pieces[pair & 0xFFFFFFFF]
        if left not in self.ids:  # a byte piece
            return True
        if left.endswith(SPACE):  # merges of spaces tie: the definition itself
            return self.merge_order(left + right) == [left, right]
        limit = (len(self.rank), 0)
        while True:
            across = self.rank.get(left + right)
            if across is not None and (across, 1) < limit:
                return False
            rank_left = self.rank[left] if left in self.parts else -1
            rank_right = self.rank[right] if right in self.parts else -1
            if rank_left < 0 and rank_right < 0:
                return True
            # The right side's merge comes after the left side's of the same rank.
            if rank_left > rank_right:
                limit, left = (rank_left, 0), self.parts[left][1]
            else:
                limit, right = (rank_right, 2), self.parts[right][0]

    def _segment(self, segment: str) -> array:
        """Ids of one word with its leading space mark."""
        # last[k]: the last piece of the prefix that ends with character k; -1 for a character outside
        # the vocabulary, and at the end of the list, which is also what precedes the first character.
        last = [-1] * (len(segment) + 1)
        pairs, size = self.pairs, self.size
        for end, i in self.automaton.iter(segment):
            if last[end] < 0:
                before = last[end - size[i]]
                if before < 0 or pairs[before << 32 | i]:
                    last[end] = i
        ids: list[int] = []
        at = len(segment) - 1
        while at >= 0:
            i = last[at]
            if i < 0:
                ids.extend(reversed(self._bytes(segment[at])))
                at -= 1
            else:
                ids.append(i)
                at -= size[i]
        ids.reverse()
        return array("I", ids)

    def _word(self, segment: str, memo: WordCache, key: str) -> bytes:
        """Ids of a segment, from those of its parts where the cut between them is certain."""
        if "\n" in segment and "\n" not in self.ids:  # no piece has a line end: what stands around it is independent
            head, *lines = key.split("\n")
            line_end = array("I", self._bytes("\n")).tobytes()
            first = memo[head] if head or memo is self.words else b""
            return first + b"".join(line_end + (self.segments[x] if x else b"") for x in lines)
        if key[-1:] in (",", ".") and len(key) > 1 and not segment.startswith(SPACE * 2):
            body, mark = memo[key[:-1]], self.ids[key[-1]]
            if self.pairs[int.from_bytes(body[-4:], "little") << 32 | mark]:
                return body + mark.to_bytes(4, "little")
        return self._segment(segment).tobytes()

    def _bytes(self, character: str) -> list[int]:
        return [self.byte_id[b] for b in character.encode()]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids with begin and end ids."""
        if not text:
            body = b""
        else:
            words = text.split(" ")
            if "" in words or SPACE in text:
                body = b"".join(map(self.segments.__getitem__, _SEGMENT.findall(SPACE + text.replace(" ", SPACE))))
            else:
                body = b"".join(map(self.words.__getitem__, words))
        return array("I", [self.bos]).tobytes() + body + array("I", [self.eos]).tobytes()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: pieces joined, without the space put before the first word."""
        out = b"".join(map(self.decoded.__getitem__, memoryview(ids).cast("I")))
        return out[1:] if out.startswith(b" ") else out


_LOADED: dict[str, PrefixTableBpe] = {}


def loaded(model_file: str) -> PrefixTableBpe:
    """One encoder per worker process and file."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTableBpe(model_file)
    return _LOADED[model_file]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, token count, ids (little-endian unsigned 32 bit), digests of ids and of the decoded text.

    A narrow job: no shuffle; the model is read from ``model_file`` on each executor.
    """
    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(model_file)
        for batch in (part for whole in batches for part in split_by_bytes(whole, 1)):
            counts, id_sums, text_sums, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                id_sums.append(hashlib.sha256(ids).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
