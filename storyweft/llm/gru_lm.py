"""A gated recurrent language model with a class-factored softmax, and whole-document scores.

Words of all training texts are counted exactly. The most frequent ones, the text end and one symbol
for all other words make up the model's vocabulary, dealt to classes by frequency: the model gives
a class, then a word of the class. A rare word's probability is that of the symbol times the word's
own share among rare words (add one), so the model is a distribution over all words.

Training is truncated backpropagation through time in numpy, one pass over all training texts: each
belongs to one round by its id. In each round every partition trains a copy of the model on its texts
of that round; Spark averages the copies and their Adagrad sums, block by block, weighted by their
tokens, in a tree of groups of bounded size. Texts run side by side in lanes; in training those of more
than ``LONGEST`` tokens are cut into parts, and no token is left out. Scoring carries the recurrent
state through a whole text, whatever its length.

Counts of words that make up more than ``FREQUENT_SHARE`` of all tokens (at most its inverse of them)
are broadcast; those of all others meet the documents that hold them in buckets of words.

Defined cases: a null text is empty and has the end token alone; without any training text every
token is unseen; repeated rows are scored alike; a row without id is scored, outside the training
texts; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.llm.storage import stored
from storyweft.llm.words import split_by_bytes, string_buffers, word_hashes, word_spans

VOCABULARY, CLASSES, HIDDEN = 4096, 32, 16
#: Averages over all partitions; copies averaged at a time.
ROUNDS, FAN = 4, 64
#: Most lanes in training, tokens that a lane is to have, steps of a window, Adagrad's rate, longest part of a text.
LANES, LANE_TOKENS, WINDOW, RATE, LONGEST = 256, 512, 24, 0.15, 2048
SCORING_LANES, SCORING_WINDOW = 512, 32
FREQUENT_SHARE = 1e-6
#: Tokens between flushes of counts; rare words that a bucket is to hold.
FLUSH, BUCKET = 3_000_000, 2_000_000
END = np.uint64(1)
_PARAMETER_BLOCK = 8192


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each text's words and one end."""
    raw, offsets = string_buffers(column)
    begin, end, row = word_spans(raw, offsets)
    n = len(offsets) - 1
    hashes = np.full(begin.size + n, END)
    hashes[np.arange(begin.size) + row] = word_hashes(raw, begin, end)
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n) + 1)))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the given texts (a column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

        for whole in batches:
            for batch in split_by_bytes(whole, 0, 4_000_000):
                held.append(tokens_of(batch.column(0))[0])
                if sum(h.size for h in held) > FLUSH:
                    yield flushed()
        if held:
            yield flushed()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Sorted hashes of the model's words and the symbol of each; symbols go by falling count."""

    hashes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    end: int
    rare: int

    @staticmethod
    def of(words: np.ndarray, counts: np.ndarray, others: int) -> Vocabulary:
        known = dict(zip(words.tolist(), counts.tolist(), strict=True))
        known.setdefault(int(END), 0)
        entries = sorted([(-c, w) for w, c in known.items()] + [(-others, -1)])
        order = {w: i for i, (_, w) in enumerate(entries)}
        hashes = np.array(sorted(known), np.uint64)
        return Vocabulary(hashes, np.array([order[int(h)] for h in hashes]), np.array([-c for c, _ in entries], float), order[int(END)], order[-1])

    def encode(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, tokens), self.hashes.size - 1)
        return np.where(self.hashes[at] == tokens, self.symbols[at], self.rare)


@dataclass
class Lanes:
    """Texts run side by side: a grid of steps and lanes in step-major order, lanes by falling length."""

    at: np.ndarray  # place of each token in the grid
    base: np.ndarray  # where each step starts
    before: np.ndarray  # symbol before each place
    fresh: np.ndarray  # whether a text starts there

    @staticmethod
    def of(symbols: np.ndarray, offsets: np.ndarray, end: int, lanes: int) -> Lanes:
        length = np.diff(offsets)
        loads = np.zeros(min(lanes, max(1, len(length))), np.int64)
        place = np.empty(len(length), np.int64)  # where a text starts in its lane
        lane = np.empty(len(length), np.int64)
        order = np.argsort(-length, kind="stable")
        # Rounds of one text for each lane, emptiest lanes first, keep the lanes about level.
        for first in range(0, len(order), len(loads)):
            some = order[first : first + len(loads)]
            free = np.argsort(loads, kind="stable")[: len(some)]
            place[some], lane[some] = loads[free], free
            loads[free] += length[some]
        rank = np.argsort(np.argsort(-loads, kind="stable"))
        lane, loads = rank[lane], -np.sort(-loads)
        owner = np.repeat(np.arange(len(length)), length)
        step = np.arange(symbols.size) - np.repeat(offsets[:-1], length) + place[owner]
        active = np.searchsorted(-loads, -np.arange(loads.max(initial=0)), side="left") if loads.size else np.zeros(0, int)
        base = np.concatenate(([0], np.cumsum(active)))
        at = base[step] + lane[owner]
        own = np.concatenate(([end], symbols[:-1]))
        starts = np.zeros(symbols.size, bool)
        starts[offsets[:-1]] = True
        own[starts] = end
        before, fresh = np.empty_like(own), np.empty(symbols.size, bool)
        before[at], fresh[at] = own, starts
        return Lanes(at, base, before, fresh)

    @property
    def steps(self) -> int:
        return len(self.base) - 1

    def widest(self, window: int) -> int:
        """Most places of so many steps; the first ones have the most lanes."""
        return int(self.base[min(window, self.steps)])


def class_borders(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where each class of the symbols (by falling count) starts: classes of about equal sums of the counts' roots, so frequent words stand in small ones."""
    mass = np.cumsum(np.sqrt(counts + 1))
    borders = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate(([0], np.minimum(borders, len(counts)), [len(counts)])))


class Gru:
    """Parameters: input table by symbol (candidate, reset, update), recurrent matrix (reset, update, candidate), class and word outputs as rows, the bias last."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, size = hidden, len(counts)
        self.borders = class_borders(counts, min(classes, size))
        self.classes = len(self.borders) - 1
        self.own = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.borders))  # class of each symbol
        smooth = np.log(counts + 1)
        mass = np.logaddexp.reduceat(smooth, self.borders[:-1])
        f = np.float32
        self.p = {
            "input": rng.normal(0, 0.3, (size, 3 * hidden)).astype(f),
            "recurrent": rng.normal(0, 1 / math.sqrt(hidden), (hidden, 3 * hidden)).astype(f),
            "class": np.column_stack((np.zeros((self.classes, hidden)), mass - np.logaddexp.reduce(mass))).astype(f),
            "word": np.column_stack((np.zeros((size, hidden)), smooth - mass[self.own])).astype(f),
        }
        #: Sums of squared gradients; one for each row of the input and the word table.
        self.sums = {name: np.zeros_like(x) for name, x in self.p.items()} | {name: np.zeros((size, 1), f) for name in ("input", "word")}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for part in (self.p, self.sums) for x in part.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for part in (self.p, self.sums):
            for name, x in part.items():
                part[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, n: np.ndarray, new: np.ndarray) -> None:
        """One step into given rows: g gets the reset and update gates and the candidate's recurrent part, n the candidate, new the state."""
        k = self.hidden
        np.matmul(h, self.p["recurrent"], out=g)
        rz = g[:, : 2 * k]
        rz += x[:, k:]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)  # the logistic function; beyond single precision it is 0
        rz += 1
        np.reciprocal(rz, out=rz)
        np.multiply(rz[:, :k], g[:, 2 * k :], out=n)
        n += x[:, :k]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= rz[:, k:]
        new += n

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after its state."""
        own, out = self.own[targets], np.empty(len(targets))
        states = np.column_stack((states, np.ones(len(states), np.float32)))
        block = 4096  # as much as stays in a core's cache
        for a in range(0, len(targets), block):
            out[a : a + block] = _chosen(self.p["class"], states[a : a + block], own[a : a + block])
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            s, e = self.borders[c], self.borders[c + 1]
            if e - s == 1:
                continue  # a class of one word
            for a in range(cuts[c], cuts[c + 1], block):
                rows = order[a : min(a + block, cuts[c + 1])]
                out[rows] += _chosen(self.p["word"][s:e], states[rows], targets[rows] - s)
        return out

    def score(self, symbols: np.ndarray, offsets: np.ndarray, end: int, lanes: int = SCORING_LANES, window: int = SCORING_WINDOW) -> np.ndarray:
        """Natural log-likelihood of each text; a lane runs its texts one after another, the longest first.

        Outputs are computed window by window, so memory holds the states of one window only.
        """
        if len(offsets) < 2:
            return np.zeros(0)
        grid, k = Lanes.of(symbols, offsets, end, lanes), self.hidden
        targets, logp = np.empty_like(symbols), np.empty(symbols.size)
        targets[grid.at] = symbols
        width = int(grid.base[1])
        most = grid.widest(window)
        x, states = np.empty((most, 3 * k), np.float32), np.empty((most, k), np.float32)
        g, n, last = np.empty((width, 3 * k), np.float32), np.empty((width, k), np.float32), np.zeros((width, k), np.float32)
        for first in range(0, grid.steps, window):
            cuts = grid.base[first : first + window + 1]
            low, high = int(cuts[0]), int(cuts[-1])
            np.take(self.p["input"], grid.before[low:high], axis=0, out=x[: high - low], mode="clip")
            cuts = (cuts - low).tolist()
            with np.errstate(over="ignore"):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    now = last[: b - a]
                    new = grid.fresh[low + a : low + b]
                    if new.any():
                        now[new] = 0
                    self.step(x[a:b], now, g[: b - a], n[: b - a], states[a:b])
                    last[: b - a] = states[a:b]
            logp[low:high] = self.log_probabilities(states[: high - low], targets[low:high])
        return np.add.reduceat(logp[grid.at], offsets[:-1])

    def train(self, symbols: np.ndarray, offsets: np.ndarray, end: int, lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> None:
        """One pass of truncated backpropagation over texts, whole or in parts, every token once; Adagrad steps."""
        if len(offsets) < 2:
            return
        grid, k = Lanes.of(symbols, offsets, end, lanes), self.hidden
        targets = np.empty_like(symbols)
        targets[grid.at] = symbols
        most = grid.widest(window)
        room = {name: np.empty((most, width * k), np.float32) for name, width in (("x", 3), ("g", 3), ("n", 1), ("held", 1), ("states", 1), ("by", 3), ("d", 4), ("some", 1))}
        last = np.zeros((grid.base[1], k), np.float32)
        for first in range(0, grid.steps, window):
            cuts = grid.base[first : first + window + 1]
            low, high = int(cuts[0]), int(cuts[-1])
            cuts = (cuts - low).tolist()
            before, fresh = grid.before[low:high], grid.fresh[low:high]
            x, g, n, held, states, by, d, some = (room[name][: high - low] for name in ("x", "g", "n", "held", "states", "by", "d", "some"))
            np.take(self.p["input"], before, axis=0, out=x, mode="clip")
            with np.errstate(over="ignore"):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    now = held[a:b]
                    now[:] = last[: b - a]
                    new = fresh[a:b]
                    if new.any():
                        now[new] = 0
                    self.step(x[a:b], now, g[a:b], n[a:b], states[a:b])
                    last = states[a:b]
            last = last.copy()
            d_states = self._learn_outputs(states, targets[low:high], rate)
            # By the state: of the candidate, the reset gate and the update gate.
            r, z, gn = g[:, :k], g[:, k : 2 * k], g[:, 2 * k :]
            by_n, by_r, by_z = by[:, :k], by[:, k : 2 * k], by[:, 2 * k :]
            np.multiply(n, n, out=some)
            np.subtract(1, some, out=some)
            np.subtract(1, z, out=by_n)
            np.multiply(by_n, z, out=by_z)
            by_n *= some
            np.subtract(held, n, out=some)
            by_z *= some
            np.subtract(1, r, out=some)
            some *= r
            np.multiply(by_n, gn, out=by_r)
            by_r *= some
            back = np.ascontiguousarray(self.p["recurrent"].T)
            d_h = np.zeros((cuts[-1] - cuts[-2], k), np.float32)
            for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
                d_now, out = d_states[a:b], d[a:b]  # out: candidate, reset, update, candidate's recurrent part
                d_now[: len(d_h)] += d_h
                np.multiply(by[a:b].reshape(b - a, 3, k), d_now[:, None, :], out=out[:, : 3 * k].reshape(b - a, 3, k))
                np.multiply(out[:, :k], r[a:b], out=out[:, 3 * k :])
                d_h = out[:, k:] @ back
                d_now *= z[a:b]
                d_h += d_now
                new = fresh[a:b]
                if new.any():
                    d_h[new] = 0
            self._learn("recurrent", np.s_[:], np.clip(held.T @ d[:, k:], -5, 5), rate)
            order = np.argsort(before.astype(np.int16) if len(self.own) < 2**15 else before, kind="stable")
            used, starts = np.unique(before[order], return_index=True)
            self._learn("input", used, np.add.reduceat(d[order, : 3 * k], starts, axis=0), rate)

    def _learn(self, name: str, where: slice | np.ndarray, gradient: np.ndarray, rate: float) -> None:
        """One Adagrad step of a part of one parameter; the gradient is used up."""
        total = self.sums[name][where]
        total = total + (np.einsum("ij,ij->i", gradient, gradient)[:, None] / np.float32(gradient.shape[1]) if self.sums[name].shape[1] < gradient.shape[1] else gradient * gradient)
        self.sums[name][where] = total
        gradient *= np.float32(rate) / np.sqrt(total + np.float32(1e-8))
        self.p[name][where] -= gradient

    def _learn_outputs(self, h: np.ndarray, targets: np.ndarray, rate: float) -> np.ndarray:
        """Step the output parameters; the gradient of the mean loss by state, before that step."""
        m, own = len(targets), self.own[targets]
        share = np.float32(1 / m)
        order = np.argsort(own, kind="stable")
        own = own[order]
        states = np.column_stack((h, np.ones(m, np.float32)))[order]
        cuts, word = np.searchsorted(own, np.arange(self.classes + 1)), targets[order] - self.borders[own]
        q = _errors(self.p["class"], states, own, share)
        d_states = q.T @ self.p["class"]
        self._learn("class", np.s_[:], q @ states, rate)
        for c in np.flatnonzero(np.diff(cuts)):
            s, e, a, b = self.borders[c], self.borders[c + 1], cuts[c], cuts[c + 1]
            if e - s == 1:
                continue
            q = _errors(self.p["word"][s:e], states[a:b], word[a:b], share)
            d_states[a:b] += q.T @ self.p["word"][s:e]
            self._learn("word", np.s_[s:e], q @ states[a:b], rate)
        d_h = np.empty_like(h)
        d_h[order] = d_states[:, :-1]
        return d_h


def _odds(weights: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unnormalised probabilities, their sums): a row for each output, a column for each state."""
    with np.errstate(over="ignore"):
        out = weights @ states.T
        np.exp(out, out=out)
        total = out.sum(axis=0)
    if not (np.isfinite(total).all() and total.min() > 0):  # beyond single precision
        out = weights @ states.T
        out -= out.max(axis=0)
        np.exp(out, out=out)
        total = out.sum(axis=0)
    return out, total


def _chosen(weights: np.ndarray, states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one output after each state."""
    odds, total = _odds(weights, states)
    return np.log(np.maximum(odds[at, np.arange(len(at))], np.float32(1e-37)) / total)


def _errors(weights: np.ndarray, states: np.ndarray, at: np.ndarray, share: np.float32) -> np.ndarray:
    """Gradient by each logit of ``share`` times the loss."""
    odds, total = _odds(weights, states)
    odds *= share / total
    odds[at, np.arange(len(at))] -= share
    return odds


def _parts(tokens: np.ndarray, offsets: np.ndarray, longest: int) -> np.ndarray:
    """Offsets that also cut texts of more than ``longest`` tokens into parts."""
    length = np.diff(offsets)
    n = -(-length // longest)
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    return np.append(np.repeat(offsets[:-1], n) + place * longest, offsets[-1])


def averaged(copies: DataFrame, partitions: int) -> DataFrame:
    """(block, values): means of all copies' blocks weighted by tokens, in groups of ``FAN`` copies at each level."""

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("weight").to_pylist(), table.column("values").to_pylist(), strict=True))
        total = sum(w for _, w, _ in rows)
        values = sum(np.frombuffer(v, np.float32) * (w / total) for _, w, v in rows)
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([rows[0][0] // FAN], pa.int64()), "weight": pa.array([total], pa.int64()), "values": pa.array([values.astype(np.float32).tobytes()], pa.binary())})

    while partitions > 1:
        copies = copies.groupBy("block", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(mean, copies.schema)
        partitions = -(-partitions // FAN)
    return copies


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Gru:
    """Train on all texts (columns ``id`` and ``text``): one slice of them in each round, after which the partitions' copies are averaged."""
    context = texts.sparkSession.sparkContext
    model = Gru(vocabulary.counts)
    total = model.flat().size
    for k in range(rounds):
        shared = context.broadcast((vocabulary, model))  # bounded by the vocabulary's size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            vocabulary, start = shared.value
            own = Gru(vocabulary.counts).load(start.flat())
            seen = 0
            for whole in batches:
                for batch in split_by_bytes(whole, 0, 4_000_000):
                    tokens, offsets = tokens_of(batch.column(0))
                    lanes = max(4, min(LANES, tokens.size // LANE_TOKENS))
                    own.train(vocabulary.encode(tokens), _parts(tokens, offsets, LONGEST), vocabulary.end, lanes)
                    seen += tokens.size
            if seen:
                flat = own.flat()
                blocks = range(0, flat.size, _PARAMETER_BLOCK)
                part = pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), part, pa.array([seen] * len(blocks), pa.int64()), pa.array([flat[b : b + _PARAMETER_BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "part", "weight", "values"])

        part = texts.filter(F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(rounds)) == k).select("text")
        copies = part.mapInArrow(run, "block long, part long, weight long, values binary")
        rows = averaged(copies, part.rdd.getNumPartitions()).select("block", "values").collect()  # one model
        if rows:
            flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r["block"])])
            assert flat.size == total
            model = Gru(vocabulary.counts).load(flat)
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, learns_from: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary_size: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """One row per row: id, n_tokens, n_known, train_tokens, base_score (unigram, add one), score; ``learns_from`` selects the training rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learns_from, F.lit(False)).alias("learns"))
    learned = texts.filter("learns").select("id", "text")
    counts = stored(count_words(learned), "gru-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("c"), "word").limit(vocabulary_size).toArrow()
    words, own = head.column("word").to_numpy().view(np.uint64), head.column("c").to_numpy()
    rare_tokens, rare_kinds = total - int(own.sum()), kinds - len(words)
    vocabulary = Vocabulary.of(words, own, rare_tokens)
    model = train(learned, vocabulary, rounds)
    listed = counts.filter(F.col("c") > total * FREQUENT_SHARE).toArrow()  # 1 / FREQUENT_SHARE rows at most
    # The end is always among them, as it has a symbol even if it was never seen.
    frequent, first = np.unique(np.concatenate((listed.column("word").to_numpy().view(np.uint64), words, [END])), return_index=True)
    frequent = frequent, np.concatenate((listed.column("c").to_numpy(), own, [0]))[first]
    shared = spark.sparkContext.broadcast((vocabulary, model, frequent))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))
    fields = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("sum_log", pa.float64()), ("rare", pa.int64()), ("rare_log", pa.float64()), ("model", pa.float64()), ("learns", pa.bool_()), ("bucket", pa.int64()), ("rows", pa.binary()), ("words", pa.binary())])
    ddl = "row long, id long, n long, known long, sum_log double, rare long, rare_log double, model double, learns boolean, bucket long, rows binary, words binary"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts, with all that is known here, and rows of buckets: packed (row, word) of the other words."""
        from pyspark import TaskContext

        vocabulary, model, (known, known_counts) = shared.value
        # One table of all frequent words: symbol (for most the one for others), logarithm of the count, the same for those without a symbol of their own.
        symbol, logs_of = vocabulary.encode(known), np.log10(known_counts + 1.0)
        rare_logs_of = np.where(np.isin(known, vocabulary.hashes, assume_unique=True), 0.0, logs_of)
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            rows, words = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            to = (words % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rows, words, to = rows[order], words[order], to[order]
            cuts = np.concatenate((np.flatnonzero(np.diff(to, prepend=-1)), [to.size])) if to.size else np.zeros(1, int)
            n = len(cuts) - 1
            nulls = [pa.nulls(n, f.type) for f in list(fields)[:9]]
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (rows, words)]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(to[cuts[:-1]], pa.int64()), *packed], schema=fields)

        for whole in batches:
            for batch in split_by_bytes(whole, 1, 8_000_000):
                tokens, offsets = tokens_of(batch.column(1))
                n = np.diff(offsets)
                owner = np.repeat(np.arange(n.size), n)
                at = np.minimum(np.searchsorted(known, tokens), known.size - 1)
                hit = known[at] == tokens
                symbols = np.where(hit, symbol[at], vocabulary.rare)
                logs = np.where(hit, logs_of[at], 0.0)
                rare = symbols == vocabulary.rare
                rare_log = np.where(hit, rare_logs_of[at], 0.0)
                rows = row + np.arange(n.size)
                row += n.size
                likelihood = model.score(symbols, offsets, vocabulary.end) / math.log(10)
                total_by = lambda x: np.bincount(owner, x, minlength=n.size)  # noqa: E731, B023
                columns = [pa.array(rows), batch.column(0), pa.array(n), pa.array(total_by(hit).astype(np.int64)), pa.array(total_by(logs)), pa.array(total_by(rare).astype(np.int64)), pa.array(total_by(rare_log)), pa.array(likelihood), batch.column(2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n.size, pa.int64()), pa.nulls(n.size, pa.binary()), pa.nulls(n.size, pa.binary())], schema=fields)
                held.append((rows[owner[~hit]], tokens[~hit]))
                if sum(h[0].size for h in held) > FLUSH // 3:
                    yield flushed()
        if held:
            yield flushed()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over a bucket's words by row: how many are known, and their logarithms (rare words all)."""
        rows = np.frombuffer(b"".join(left.column("rows").to_pylist()), np.int64)
        words = np.frombuffer(b"".join(left.column("words").to_pylist()), np.uint64)
        known, c = right.column("word").to_numpy().view(np.uint64), right.column("c").to_numpy()
        by = np.argsort(known)
        known, c = known[by], c[by]
        if known.size and rows.size:
            at = np.minimum(np.searchsorted(known, words), known.size - 1)
            hit = known[at] == words
            rows, logs = rows[hit], np.log10(c[at][hit] + 1.0)
        else:
            rows, logs = rows[:0], np.zeros(0)
        used, inverse = np.unique(rows, return_inverse=True)
        n, total = np.bincount(inverse, minlength=used.size), np.bincount(inverse, logs, minlength=used.size)
        to = used % buckets
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate((np.flatnonzero(np.diff(to[order], prepend=-1)), [used.size])) if used.size else np.zeros(1, int)
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        packed = [pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (used, n.astype(np.int64), total.astype(float))]
        return pa.table({"to": pa.array([int(to[p[0]]) for p in parts], pa.int64()), "rows": packed[0], "known": packed[1], "logs": packed[2]})

    def sum_up(table: pa.Table) -> pa.Table:
        """Sums of all buckets' parts by row."""
        rows, known, logs = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rows", np.int64), ("known", np.int64), ("logs", float)))
        used, inverse = np.unique(rows, return_inverse=True)
        return pa.table({"row": pa.array(used, pa.int64()), "more_known": pa.array(np.bincount(inverse, known, minlength=used.size).astype(np.int64)), "more_log": pa.array(np.bincount(inverse, logs, minlength=used.size).astype(float))})

    # Written once: the row numbers of a text and of its words must come from the same run.
    measured = stored(texts.select("id", "text", "learns").mapInArrow(measure, ddl), "gru-measured")
    infrequent = counts.filter(F.col("c") <= total * FREQUENT_SHARE)
    # Hashes are unsigned: the remainder of the two halves gives the same bucket as in the task.
    high, low = F.shiftrightunsigned("word", 32), F.col("word").bitwiseAND(F.lit(0xFFFFFFFF))
    bucket = F.pmod(F.pmod(high, F.lit(buckets)) * ((1 << 32) % buckets) + low, F.lit(buckets)).cast("long")
    packed = measured.filter("bucket is not null").select("bucket", "rows", "words")
    found = packed.groupBy("bucket").cogroup(infrequent.select(bucket.alias("of"), "word", "c").groupBy("of")).applyInArrow(look_up, "to long, rows binary, known binary, logs binary")
    sums = found.groupBy("to").applyInArrow(sum_up, "row long, more_known long, more_log double")
    rows = measured.filter("row is not null").drop("bucket", "rows", "words").join(sums, "row", "left").fillna(0, ["more_known", "more_log"])
    base = F.col("sum_log") + F.col("more_log") - F.col("n") * math.log10(total + kinds + 1)
    score = F.col("model") + F.col("rare_log") + F.col("more_log") - F.col("rare") * math.log10(rare_tokens + rare_kinds + 1)
    return rows.select(F.col("id").alias(id_col), (~F.col("learns")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
