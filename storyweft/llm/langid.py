"""Language identification by interpolated Kneser-Ney character models.

One character model per language is estimated on a bounded sample of labelled texts. The models
share one table per order: the sorted hashes of all character n-grams seen in any language, with
every language's interpolated log-probability beside them, and the sorted hashes of all contexts
with their back-off weights. A text gets the language of the lowest cross-entropy per character.
It is rejected when even that is far above what held-back texts of the language have: entropies
scatter about a language's median, the more the shorter the text, by a scale that all languages share;
the limit is a multiple of a high quantile of that scatter. Median, scale and quantile are drawn towards
pooled or usual values as far as held-back texts are few, so rejection works alike at every size.

Texts are folded first: letters are lower-cased, runs of anything else become one space.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected;
languages with equal cross-entropy go by name; with no labelled text at all everything is ``und``;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.llm.words import split_by_bytes, string_buffers

ORDER = 4
#: Bounds of the training sample: texts of a language, and characters of a text (of a longer one an excerpt, its place drawn by the id's hash).
SAMPLE_TEXTS = 800
SAMPLE_CHARS = 20_000
#: Languages that one set of models may tell apart; each adds a column to all tables.
MAX_LANGUAGES = 256
#: Each so-manieth sampled text is held back to calibrate rejection.
CALIBRATION = 3
#: From so many letters on, entropies scatter by text rather than by length.
LONG = 400
#: The quantile of held-back texts' excess over their language's median, how many deviations a short text may add, and
#: how many times both a text may exceed before it is rejected.
QUANTILE, DEVIATIONS, TIMES = 0.99, 2.33, 2.0
#: Usual scale in nats (times the root of 1 / length + 1 / LONG) and excess of long texts, and as how many held-back texts they count.
USUAL_SCALE, USUAL_EXCESS, WEIGHT = 0.6, 0.2, 20
#: Nats of log-likelihood ratio count for the score as if a text had this many characters.
SCORE_CHARS = 20.0
_BASE = 0x100000001B3


def _folding() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: list[np.ndarray] = []


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, letters): folded code points of all texts in a row, each with a space before it; where each text starts; its letters."""
    if not _FOLD:
        _FOLD.append(_folding())
    raw, offsets = string_buffers(texts)
    n = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    at = lead[offsets]
    codes = _FOLD[0][np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    codes = np.insert(codes, at[:-1], 32)  # a space before each text, so that no n-gram crosses a border unseen
    first = at[:-1] + np.arange(n)
    space = codes == 32
    keep = np.ones(codes.size, bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[first] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    first = place[first]
    codes = codes[keep]
    letters = np.add.reduceat((codes != 32).astype(np.int64), first)
    return codes, first, letters


def grams(codes: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1..order-grams that end at each position; beyond a text's start all is space."""
    n = codes.size
    since = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    out = [codes.astype(np.uint64) + np.uint64(1)]
    power = np.uint64(1)
    for k in range(1, order):
        power = np.uint64(int(power) * _BASE % 2**64)
        before = np.full(n, 33, np.uint64)
        before[k:] = codes[:-k]
        before[k:] += np.uint64(1)
        before[since < k] = 33
        out.append(out[-1] + before * power)
    return out


@dataclass
class Models:
    """Tables for all languages; ``keys[k]`` are sorted hashes of (k + 1)-grams."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    medians: np.ndarray
    excess: float
    narrow: float

    def limits(self, best: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Highest cross-entropy accepted for texts of the given languages and lengths."""
        return self.medians[best] + self.excess + self.narrow / np.sqrt(np.maximum(letters, 1))

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per character by language, letters) of each text."""
        codes, first, letters = folded(texts)
        n, languages = codes.size, len(self.languages)
        if not first.size:
            return np.zeros((0, languages)), letters
        order = len(self.keys)
        hashes = grams(codes, first, order)
        result = np.empty((n, languages), np.float32)
        pending = np.arange(n)
        carried = np.zeros((n, languages), np.float32)
        for k in range(order - 1, -1, -1):
            keys, h = self.keys[k], hashes[k][pending]
            at = np.minimum(np.searchsorted(keys, h), keys.size - 1)
            found = keys[at] == h
            result[pending[found]] = carried[found] + self.logp[k][at[found]]
            pending, carried = pending[~found], carried[~found]
            if k and pending.size:
                # The context of a (k + 1)-gram is the k-gram that ends one before.
                contexts = self.contexts[k - 1]
                before = np.where(pending > 0, hashes[k - 1][pending - 1], 0)
                at = np.minimum(np.searchsorted(contexts, before), contexts.size - 1)
                carried = carried + np.where((contexts[at] == before)[:, None], self.backoff[k - 1][at], 0)
        result[pending] = carried + self.floor
        total = np.add.reduceat(result, first, axis=0, dtype=np.float64)
        return -total / np.diff(np.append(first, n))[:, None], letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        entropy, letters = self.entropies(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-SCORE_CHARS * (entropy - low[:, None])).sum(axis=1)
        none = letters == 0
        names = np.where(none, "und", np.array(self.languages, object)[best])
        return names.tolist(), np.where(none, 0.0, score), none | (low > self.limits(best, letters))


def _width(letters: np.ndarray) -> np.ndarray:
    """How far entropies of texts of a length scatter, up to a factor."""
    return np.sqrt(1 / np.maximum(letters, 1) + 1 / LONG)


def _calibrated(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float, float]:
    """(median by language, excess, narrow) from the held-back (entropies, letters) of each language.

    ``excess`` is how far long texts lie above their median, of all languages together; ``narrow`` over the
    root of its length is what a short text may add by chance. Few held-back texts are joined by usual values.
    """
    pooled = np.concatenate([e for e, _ in held]) if held else np.zeros(0)
    middle = float(np.median(pooled)) if pooled.size else 0.0
    medians = np.array([(len(e) * np.median(e) + WEIGHT / 4 * middle) / (len(e) + WEIGHT / 4) if len(e) else middle for e, _ in held])
    above = np.concatenate([e - m for (e, _), m in zip(held, medians, strict=True)]) if held else np.zeros(0)
    letters = np.concatenate([n for _, n in held]) if held else np.zeros(0)
    far = above[letters >= LONG]
    excess = (far.size * (float(np.quantile(far, QUANTILE)) if far.size else 0.0) + WEIGHT * USUAL_EXCESS) / (far.size + WEIGHT)
    scale = (above.size * (1.4826 * float(np.median(np.abs(above / _width(letters)))) if above.size else 0.0) + WEIGHT * USUAL_SCALE) / (above.size + WEIGHT)
    return medians, TIMES * max(0.0, excess), TIMES * DEVIATIONS * scale


def _counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def _language_tables(codes: np.ndarray, first: np.ndarray, order: int) -> list[dict]:
    """Per order: distinct grams, their count (of distinct left neighbours below the top order), context and last character."""
    hashes = grams(codes, first, order)
    before = [np.concatenate(([np.uint64(0)], h[:-1])) for h in hashes]
    tables = []
    for k in range(order):
        keys, at = np.unique(hashes[k], return_index=True)
        if k == order - 1:
            count = _counts(hashes[k])[1].astype(float)
        else:  # each distinct (k + 2)-gram is one left neighbour of its (k + 1)-gram
            _, longer = np.unique(hashes[k + 1], return_index=True)
            count = _counts(hashes[k][longer])[1].astype(float)
        context = before[k - 1][at] if k else np.zeros(keys.size, np.uint64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        tables.append({"keys": keys, "count": count, "context": context, "shorter": hashes[k - 1][at] if k else None, "discount": ones / (ones + 2 * twos) if ones and twos else 0.5})
    return tables


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models of the languages of some labelled texts."""
    languages = sorted(texts)
    fitted, held = {}, {}
    for name in languages:
        held[name] = texts[name][::CALIBRATION] if len(texts[name]) > 1 else []  # a single text can't be held back
        kept = [t for i, t in enumerate(texts[name]) if i % CALIBRATION or not held[name]]
        codes, first, _ = folded(pa.array(kept, pa.string()))
        fitted[name] = _language_tables(codes, first, order)
    floor = -np.log(max(2, len(np.unique(np.concatenate([fitted[x][0]["keys"] for x in languages])))) * 4.0) if languages else 0.0
    keys, logp, contexts, backoff = [], [], [], []
    lower: list[np.ndarray] = []  # probabilities by language of the grams one shorter
    for k in range(order if languages else 0):
        union = np.unique(np.concatenate([fitted[x][k]["keys"] for x in languages]))
        own_contexts = np.unique(np.concatenate([fitted[x][k]["context"] for x in languages]))
        p = np.zeros((union.size, len(languages)))
        weights = np.zeros((own_contexts.size, len(languages)), np.float32)
        # Any language's row gives a gram's context and its shorter gram: both are parts of it.
        context, shorter = np.zeros(union.size, np.uint64), np.zeros(union.size, np.uint64)
        for x in languages:
            at = np.searchsorted(union, fitted[x][k]["keys"])
            context[at] = fitted[x][k]["context"]
            if k:
                shorter[at] = fitted[x][k]["shorter"]
        for j, x in enumerate(languages):
            t = fitted[x][k]
            names, inverse = np.unique(t["context"], return_inverse=True)
            total = np.bincount(inverse, t["count"])
            kinds = np.bincount(inverse)
            where = np.searchsorted(union, t["keys"])
            p[where, j] = np.maximum(t["count"] - t["discount"], 0) / total[inverse]
            lam = np.ones(own_contexts.size)
            lam[np.searchsorted(own_contexts, names)] = t["discount"] * kinds / total
            weights[:, j] = np.log(lam)
            below = np.exp(floor) if not k else lower[-1][np.searchsorted(keys[-1], shorter), j]
            p[:, j] += lam[np.searchsorted(own_contexts, context)] * below
        keys.append(union)
        logp.append(np.log(p).astype(np.float32))
        lower.append(p)
        if k:
            contexts.append(own_contexts)
            backoff.append(weights)
        else:
            floor += float(weights[0].mean())
    models = Models(languages, keys, logp, contexts, backoff, floor, np.zeros(len(languages)), 0.0, 0.0)
    measured = []
    for j, x in enumerate(languages):
        entropy, letters = models.entropies(pa.array(held[x], pa.string()))
        measured.append((entropy[letters > 0, j], letters[letters > 0]))
    models.medians, models.excess, models.narrow = _calibrated(measured)
    return models


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Models:
    """Models from about ``sample_texts`` different texts of each language, drawn by a hash of id and text: a fixed bound, whatever the table's size or its most frequent id.

    Copies are dropped in Spark, before the sample comes to the driver.
    """
    draw = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40))
    excess = F.greatest(F.length(text_col) - sample_chars, F.lit(0))
    excerpt = F.substring(F.col(text_col), (F.pmod(draw, excess + 1) + 1).cast("int"), F.lit(sample_chars))
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(lang_col).alias("lang"), excerpt.alias("text"), draw.alias("draw"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return fit({})
    # Shares as a literal, so that no text is shuffled for its language.
    share = F.element_at(F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_texts / max(r["n"], 1))))), F.col("lang"))
    drawn = usable.filter(F.col("draw") < share * float(1 << 40))
    texts: dict[str, list[str]] = {}
    for r in drawn.select("lang", "text").distinct().toArrow().to_pylist():
        texts.setdefault(r["lang"], []).append(r["text"])
    return fit({lang: sorted(own) for lang, own in texts.items()}, order)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, lang_pred, score (0 to 1), rejected. A narrow job; only id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [id_col, "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_by_bytes(whole, 1, 1_000_000):
                lang, score, rejected = shared.value.predict(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, lang_pred string, score double, rejected boolean")


def filter_identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with all their columns. A narrow job."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_by_bytes(whole, at, 1_000_000):
                yield batch.filter(pa.array(~shared.value.predict(batch.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)
