"""Column functions on texts, dates, URLs and JSON; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words that mark English (fixed values).
ENGLISH_MARKERS = ("the", "and", "is", "in", "it", "to", "that", "of", "for", "on")
#: ASCII punctuation (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Four classes of entities: pattern, and the group that is the entity (fixed values).
ENTITY_PATTERNS = {
    "persons": (r"(?:[A-Z][a-z]+ ){1,2}[A-Z][a-z]+", 0),
    "organizations": (r"(?:[A-Z][a-z]+ ){2,}(?:Inc|LLC|Ltd|Corp|Corporation|Company|Group)", 0),
    "locations": (r"(?:in|at|from|to) ([A-Z][a-z]+(?: [A-Z][a-z]+)?)", 1),
    "dates": (r"\b(?:\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{2,4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\b", 0),
}
#: Date formats in the order in which they are tried (fixed values); one digit is enough for a day or month.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s'Z'",
    "yyyy-M-d H:m:s",
    "d-M-yyyy",
    "M/d/yyyy",
    "d/M/yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "yyyy/M/d",
)
#: Hosts that are known to be credible (fixed values).
CREDIBLE_HOSTS = (
    "reuters.com",
    "apnews.com",
    "bbc.co.uk",
    "bbc.com",
    "nytimes.com",
    "wsj.com",
    "washingtonpost.com",
    "economist.com",
    "nature.com",
    "science.org",
    "nasa.gov",
    "nih.gov",
    "cdc.gov",
    "who.int",
)


def clean_text(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower case, without URLs, tags within a line and ASCII punctuation, single spaces; optionally without stop words.

    What is removed leaves no space: "don't" becomes "dont". A null text is empty.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)https?://\S+|www\.\S+", "")
    out = F.regexp_replace(out, r"<[^\n]*?>", "")
    out = F.translate(out, PUNCTUATION, "")
    out = F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))
    if stop_words:
        stops = list(stop_words)
        out = F.array_join(F.filter(F.split(out, " "), lambda w: ~w.isin(*stops)), " ")
    return out


def clean_text_light(text: Column, urls: bool = True, tags: bool = True) -> Column:
    """Without URLs and tags as asked, single spaces; case and punctuation stay."""
    out = F.regexp_replace(text, r"https?://[^ ]+", "") if urls else text
    out = F.regexp_replace(out, r"<[^>]*>", " ") if tags else out
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ? or ! before white space, not after common abbreviations or initials."""
    marked = F.regexp_replace(text, r"(?<!\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|[A-Z]))([.?!])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def is_claim(sentence: Column, verbs: Sequence[str]) -> Column:
    """Whether a sentence states something: it holds a number or one of the verbs, and isn't a question."""
    return sentence.rlike("|".join(["[0-9]", *([r"(?i)\b(?:" + "|".join(verbs) + r")\b"] if verbs else [])])) & ~sentence.endswith("?")


def words(text: Column) -> Column:
    """Array of lower-cased words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def domain(url: Column) -> Column:
    """Host of a URL without ``www.``; null if there is none."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def detect_language(text: Column, least: int = 3) -> Column:
    """``en`` with more than three of ten markers among the words of the cleaned text, else ``unknown``."""
    found = F.size(F.array_intersect(F.split(clean_text(text), " "), F.array(*map(F.lit, ENGLISH_MARKERS))))
    return F.when(found > least, "en").otherwise("unknown")


def entities(text: Column, kind: str) -> Column:
    """Array of distinct entities of a class, sorted."""
    pattern, group = ENTITY_PATTERNS[kind]
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def normalize_date(text: Column) -> Column:
    """ISO form of a date in one of ten formats; null for an empty one, any other text as it is."""
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))
    return F.when(text != "", F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), text))


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO 8601 text: a date (calendar or week, with or without dashes), and a time to the hour, minute, second or fraction, with or without offset.

    A time without offset is read in the session's time zone; ``Z`` is an offset of zero; anything else is null.
    """
    clock = r"\d\d(?::\d\d(?::\d\d(?:[.,]\d+)?)?|\d\d(?:\d\d(?:[.,]\d+)?)?)?(?:[+-]\d\d(?::?\d\d)?)?"
    week_of = r"^(\d{4})-?W(\d\d)(?:-?([1-7]))?"
    own = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    valid = own.rlike(rf"^(?:\d{{4}}-\d\d-\d\d|\d{{8}}|\d{{4}}-W\d\d(?:-[1-7])?|\d{{4}}W\d\d[1-7]?)(?:.{clock})?$")
    # A week's day counts from the Monday of the week that holds 4 January.
    number = lambda group: F.coalesce(F.try_to_number(F.regexp_extract(own, week_of, group), F.lit("9999")).cast("int"), F.lit(1))
    monday = F.date_trunc("week", F.make_date(number(1), F.lit(1), F.lit(4))).cast("date")
    day = F.date_add(monday, (number(2) - 1) * 7 + number(3) - 1).cast("string")
    out = F.when(own.rlike(week_of), F.concat(day, F.regexp_replace(own, week_of, ""))).otherwise(F.regexp_replace(own, r"^(\d{4})(\d\d)(\d\d)(?=\D|$)", "$1-$2-$3"))
    for pattern, form in (
        (r"^(.{10}).(\d\d)(\d\d)(\d\d)", "$1T$2:$3:$4"), (r"^(.{10}).(\d\d)(\d\d)(?=\D|$)", "$1T$2:$3"), (r"^(.{10}).(\d\d)(?=\D|$)", "$1T$2"),
        (r"^(.{10}T\d\d)(?=[+-]|$)", "$1:00"), (r"^(.{10}T\d\d:\d\d)(?=[+-]|$)", "$1:00"), (r"[.,](\d{1,6})\d*", ".$1"), (r"(T.*[+-]\d\d)(\d\d)$", "$1:$2"), (r"(T.*[+-]\d\d)$", "$1:00"),
    ):
        out = F.regexp_replace(out, pattern, form)
    return F.when(valid, F.try_to_timestamp(out))


def truncated(text: Column, length: int) -> Column:
    """At most ``length`` characters, with dots where something was cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def time_decay(weight: Column, days: Column, rate: float) -> Column:
    return weight * F.exp(-rate * days)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def meta_get(meta: Column, path: str, default: Column) -> Column:
    """Value at a JSON path as text; the default for null, malformed or missing."""
    return F.coalesce(F.get_json_object(meta, path), default)


def meta_merge(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects of text values; the new one wins, malformed ones are empty."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(parsed(old), lambda k, v: ~F.map_contains_key(parsed(new), k))
    return F.to_json(F.map_concat(kept, parsed(new)))


def repair_feed_xml(text: Column) -> Column:
    """Named entities that XML lacks become characters, an unclosed CDATA start goes, a prolog is put first."""
    out = F.replace(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&ndash;"), F.lit("-")), F.lit("&mdash;"), F.lit("-"))
    opened, closed = F.regexp_count(out, F.lit(r"<!\[CDATA\[")), F.regexp_count(out, F.lit(r"\]\]>"))
    out = F.when(opened > closed, F.replace(out, F.lit("<![CDATA["), F.lit(""))).otherwise(out)
    return F.when(F.ltrim(out).startswith("<?xml"), out).otherwise(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), out))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags, single spaces."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def page_links(html: Column, base: Column) -> Column:
    """Array of absolute links of a page: anchors and scripts left out, relative ones resolved against the base."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    kept = F.filter(found, lambda u: ~u.startswith("#") & ~F.lower(u).startswith("javascript:") & (u != ""))
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.transform(kept, lambda u: F.when(u.rlike("^https?://"), u).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(root, F.lit("/"), u)))


def credibility_score(url: Column, text: Column, links: Column) -> Column:
    """Weights .4 domain tier, .3 length, .15 lexical diversity, .15 number of links, rounded to two places."""
    host = F.coalesce(domain(url), F.lit(""))
    known = F.lit(False)
    for name in CREDIBLE_HOSTS:
        known = known | host.contains(name)
    tier = F.when(known, 0.9).when(host.contains(".gov"), 0.85).when(host.contains(".edu"), 0.8).when(host.contains(".org"), 0.7).otherwise(0.5)
    size = F.when(F.length(text) > 1000, 0.7).otherwise(0.5)
    own = split_words(text)
    diversity = F.when(F.size(own) > 0, F.least(F.lit(1.0), 2 * F.size(F.array_distinct(own)) / F.size(own))).otherwise(F.lit(0.0))
    cited = F.when(links > 5, 0.8).when(links > 0, 0.6).otherwise(0.4)
    return F.round(0.4 * tier + 0.3 * size + 0.15 * diversity + 0.15 * cited, 2)


def split_words(text: Column) -> Column:
    """Array of lower-cased words between white space, with their punctuation."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def relevance(text: Column, keywords: Sequence[str], threshold: float = 0.01) -> Column:
    """Occurrences of keywords, within words too, over words times ten, at most 1; 0 below the threshold."""
    low = F.lower(text)
    hits = F.lit(0.0)
    for word in (k.lower() for k in keywords):
        hits = hits + (F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)
    n = F.size(split_words(text))
    score = F.when(n > 0, F.least(F.lit(1.0), hits / n * 10)).otherwise(F.lit(0.0))
    return F.when(score >= threshold, score).otherwise(F.lit(0.0))


def evidence_hash(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of columns (in the order given: sort names first)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
