r"""Personal data: fixed patterns, and bootstrapped contextual extraction, in column expressions only.

*Base* spans follow four fixed patterns, leftmost and non-overlapping by kind. They are the seeds.
The words before an identifier are its lexical pattern. One pass over the texts gives the graph of
patterns and the identifier-like tokens they introduce (*instances*), seeds and look-alikes, whatever
their context. Spark scores the graph in rounds: an instance is believed as far as its patterns say
(a seed fully); a pattern is as good as the lower confidence bound of its believed instances against
the everyday words that it also introduces. Instances that come to be believed lend support to further
patterns, which need no seed of their own, and so on until no pattern is added. Believed patterns
discover identifiers that the fixed patterns don't match.

Edges of the graph are aggregated to distinct (kind, pattern, instance) before any join, so copies
of a text count once. A pattern must introduce a fixed share of a kind's seeds, or of all its
instances, hence at most ``2 / MIN_SHARE`` patterns of a kind are brought to the driver and compiled
into one expression; texts are then searched where they are read. No threshold is a number of rows:
a pattern with few instances fails by its wide confidence interval, on tables of every size.

Positions are counted in code points, ends exclusive: the text is split at the matches, and the
lengths of parts and matches add up to the positions.

Defined cases: a null text is empty; texts without matches give empty spans; overlapping matches of
different kinds are all kept; a discovered span never overlaps a base span; repeated rows give
repeated results; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")

# What the base patterns match. Runs are possessive and a match starts only where a
# run starts or the last match ended; neither changes a match, and each text is read in linear time.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

#: What a text must hold for a base pattern to match at all: a literal, or an expression that is quick to search.
_HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Shapes of identifiers that a trusted context may introduce beyond the base patterns.
_CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]{2,64}(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{2,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}",
    "card": r"[0-9]{4}(?:[._/][0-9]{4}){3}",
    "phone": r"\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-]?[0-9]{3,4}",
}
#: A part of each shape that is rare and quick to search.
_TRACES = {
    "email": r"[ \])]at[ \[(]?[ \])]?[A-Za-z0-9-]{2,63}(?: ?[\[(] ?dot| dot |\.[A-Za-z0-9-])|[\[(] ?at ?[\])]",
    "ip": r":[0-9A-Fa-f]{0,4}:",
    "card": r"[0-9][._/][0-9]{4}[._/]",
    "phone": r"[0-9]{3}[ ./-]?[0-9]{3}",
}
#: The lexical pattern of a span: one or two words before it, the last ending in a letter or a colon.
_CONTEXT_WORDS = r"(?:(?<![^\s])[\p{L}]{1,30}\s)?[\p{L}]{2,30}:?\s"
#: Characters before a span that its pattern is taken from.
_WINDOW = 64

#: Rounds of belief at most; the loop ends before when no pattern is added.
ROUNDS = 10
#: A believed pattern's least score, and the least share of its kind's seeds, or of all its instances, that it introduces.
MIN_SCORE, MIN_SHARE = 0.6, 0.005
#: Square of the normal quantile of the confidence bound (95 %, two-sided).
_Z2 = 1.96**2


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, value) of all matches, in order."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["part"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda part, value: F.struct(part.alias("part"), value.alias("value")))
    spans = F.aggregate(pairs, start, step)["spans"]
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the base matches, by kind as listed, then start."""
    own = {kind: _kept(matches(text, _PATTERNS[kind], kind), kind) for kind in KINDS}
    # Cheap tests first: most texts hold no match at all, and most hold no digit.
    hint = {kind: text.contains(_HINTS[kind]) & text.rlike(_PATTERNS[kind].replace(r"\G|", "")) for kind in KINDS}
    numbers = F.concat(*(F.when(hint[kind], own[kind]).otherwise(_no_spans()) for kind in KINDS[1:]))
    return F.concat(F.when(hint["email"], own["email"]).otherwise(_no_spans()), F.when(text.rlike("[0-9]"), numbers).otherwise(_no_spans()))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def of_kind(spans: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda s: s["kind"] == kind)


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")


def _context(before: Column) -> Column:
    """Lower-cased words at the end of what stands before a span; empty without a word."""
    return F.lower(F.trim(F.regexp_extract(before, f"({_CONTEXT_WORDS})$", 1)))


_EDGE = "array<struct<kind:string,pattern:string,instance:bigint,seed:boolean>>"


def _edge(text: Column, s: Column, seed: bool) -> Column:
    """One edge of the graph: a span and the words before it."""
    before = F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - _WINDOW), F.least(F.lit(_WINDOW), s["start"]))
    return F.struct(s["kind"].alias("kind"), _context(before).alias("pattern"), F.xxhash64(s["value"]).alias("instance"), F.lit(seed).alias("seed"))


def _look_alikes(text: Column, kind: str) -> Column:
    """Array of edges: the look-alikes of a kind that follow a word, and the words before each."""
    spans = matches(text, rf"(?<=[\p{{L}}:]\s){_CANDIDATES[kind]}(?![\p{{L}}0-9@])", kind)
    return F.when(text.rlike(_TRACES[kind]), F.transform(spans, lambda s: _edge(text, s, False))).otherwise(F.array()).cast(_EDGE)


def _edges(texts: DataFrame) -> DataFrame:
    """Distinct (kind, pattern, instance, seed): what base matches and look-alikes stand behind which words; one pass over (text, base)."""
    text = F.col("text")
    numbers = F.when(text.rlike("[0-9]"), F.concat(*(_look_alikes(text, kind) for kind in KINDS[1:]))).otherwise(F.array().cast(_EDGE))
    found = F.concat(F.transform("base", lambda s: _edge(text, s, True)).cast(_EDGE), _look_alikes(text, "email"), numbers)
    # An outer explode: before a plain one Spark would filter by the array's size and so search the texts again.
    rows = texts.select(F.explode_outer(found).alias("e")).select("e.*")
    return rows.filter(F.col("pattern") != "").groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))


def _spoken(patterns: list[str]) -> str:
    """An expression for any of some lexical patterns, the longest first."""
    return "|".join(re.escape(w).replace(r"\ ", r"\s") for w in sorted(patterns, key=lambda w: (-len(w), w)))


def _introduced(hits: Column, kind: str, spoken: str) -> Column:
    return F.transform(hits, lambda hit: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(F.regexp_extract(hit, rf"^({spoken})\s", 1), r"\s", " ").alias("pattern"), F.xxhash64(hit).alias("word")))


def _everyday(texts: DataFrame, listed: dict[str, list[str]]) -> DataFrame:
    """(kind, pattern, others): how many different words a pattern introduces that have no identifier's shape."""
    found = []
    for kind, words in listed.items():
        spoken = _spoken(words)
        shape = f"(?:{_CANDIDATES[kind]})(?![\\p{{L}}0-9@])|{_PATTERNS[kind]}"
        hits = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}])(?:{spoken})\s(?!{shape})\S+"), F.lit(0))
        found.append(_introduced(hits, kind, spoken))
    rows = texts.select(F.explode_outer(F.concat(*found)).alias("e")).select("e.*").filter("kind is not null").distinct()
    return rows.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("others"))


def _bound(good: Column, bad: Column) -> Column:
    """Lower end of Wilson's confidence interval of the share of the good."""
    n = good + bad
    p = good / n
    return (p + _Z2 / (2 * n) - F.sqrt(_Z2 * (p * (1 - p) + _Z2 / (4 * n)) / n)) / (1 + _Z2 / n)


def learn_patterns(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_share: float = MIN_SHARE) -> dict[str, list[str]]:
    """Believed lexical patterns by kind; at most ``2 / min_share`` of each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"))
    edges = stored(_edges(texts.withColumn("base", base_spans(F.col("text")))), "pii-edges")
    # Patterns that could ever be believed: their number is bounded, and so is every join below.
    totals = edges.groupBy("kind").agg(F.count_if("seed").alias("kind_seeds"), F.count(F.lit(1)).alias("kind_instances"))
    support = edges.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("instances"))
    large = ((F.col("seeds") > 0) & (F.col("seeds") >= F.col("kind_seeds") * min_share)) | (F.col("instances") >= F.col("kind_instances") * min_share)
    hopeful = _bound(F.col("instances").cast("double"), F.lit(0.0)) >= min_score  # if all that it introduces were believed
    able = stored(support.join(F.broadcast(totals), "kind").filter(large & hopeful).select("kind", "pattern"), "pii-patterns")
    listed: dict[str, list[str]] = {}
    for row in able.collect():  # as many as are believed at most
        listed.setdefault(row["kind"], []).append(row["pattern"])
    if not listed:
        return {}
    able = stored(able.join(_everyday(texts, listed), ["kind", "pattern"], "left").fillna(0, ["others"]), "pii-able")
    graph = stored(edges.join(F.broadcast(able), ["kind", "pattern"]), "pii-graph")
    believed: dict[str, list[str]] = {}
    trusted = able.limit(0).select("kind", "pattern", F.lit(0.0).alias("score"))
    for _ in range(rounds):
        doubt = F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999))))
        belief = (
            graph.join(F.broadcast(trusted), ["kind", "pattern"], "left")
            .groupBy("kind", "instance")
            .agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
            .select("kind", "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(1.0) - F.exp("doubt")).alias("belief"))
        )
        good = F.sum("belief")
        scored = graph.join(belief, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.when(good > 0, _bound(good, F.first("others").cast("double"))).otherwise(0.0).alias("score"))
        trusted = stored(scored.filter(F.col("score") >= min_score), "pii-round")
        before, believed = believed, {}
        for row in trusted.orderBy("kind", "pattern").collect():
            believed.setdefault(row["kind"], []).append(row["pattern"])
        if believed == before:
            break
    return believed


def _without_lead(spans: Column, lead: str) -> Column:
    """Spans cut down to what stands after the words that introduce it."""

    def inner(s: Column) -> Column:
        value = F.regexp_replace(s["value"], lead, "")
        return F.struct(s["kind"].alias("kind"), (s["end"] - F.length(value)).alias("start"), s["end"].alias("end"), value.alias("value"))

    return F.transform(spans, inner)


def discovered_spans(text: Column, base: Column, patterns: dict[str, list[str]]) -> Column:
    """Array of (kind, start, end, value) that believed patterns introduce, clear of all base spans."""
    own = [_no_spans()]
    for kind, words in patterns.items():
        spoken = _spoken(words)
        pattern = rf"(?iu)(?<![\p{{L}}])(?:{spoken})\s(?-i:{_CANDIDATES[kind]})(?![\p{{L}}0-9@])"
        lead = rf"(?iu)^(?:{spoken})\s"

        spans = _without_lead(matches(text, pattern, kind), lead)
        clear = F.filter(spans, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        own.append(F.when(text.rlike(pattern), clear).otherwise(_no_spans()))
    return F.concat(*own)


def find(docs: DataFrame, patterns: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, text, base and spans (both arrays of kind, start, end, value). A narrow job."""
    rank = F.create_map(*(x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    more = discovered_spans(F.col("text"), F.col("base"), patterns)
    keyed = F.transform(F.concat("base", more), lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.withColumn("spans", ordered if patterns else F.col("base"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the one that starts first counts, and all are covered."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        end = F.greatest(state["at"], -s["back"])
        kept = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(end.alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out"))

    end = F.aggregate(by_start, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text))))


def mask_documents(docs: DataFrame, patterns: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the texts masked; a null text stays null."""
    held = "_spans_of_personal_data"  # computed once, used several times
    text, base = F.col(text_col), F.col(held)
    found = docs.withColumn(held, base_spans(text))
    if patterns:
        found = found.withColumn(held, F.concat(base, discovered_spans(text, base, patterns)))
    return found.withColumn(text_col, F.when(text.isNotNull(), masked(text, base))).drop(held)
