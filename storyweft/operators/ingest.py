"""Captured feeds, outlines, posts and pages to rows; all parsing runs in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions.text import clean_text, normalize_date, truncated, words

_ITEM = "struct<title:string,link:string,description:string,summary:string,content:array<string>,encoded:array<string>,pubDate:string,published:string,author:string>"
_ENTRY = "struct<title:string,link:array<struct<_href:string,_rel:string,_type:string>>,summary:string,content:array<string>,published:string,updated:string,author:struct<name:string>>"
_FEED = f"channel struct<title:string,item:array<{_ITEM}>>, title string, entry array<{_ENTRY}>"


def parse_feed_items(feeds: DataFrame, most: int) -> DataFrame:
    """Items of RSS and Atom documents (feed_id, xml): feed title, place, title, content, link, published, author; the first ``most`` of each.

    Content is all content elements, else the summary or description. The link of an Atom entry is its last
    alternate one that leads to a page. What is missing is ``Unknown Feed``, ``No Title`` or empty. A
    document that isn't XML gives no items.
    """
    parsed = feeds.select("feed_id", F.from_xml("xml", _FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("f"))
    or_else = lambda value, default: F.coalesce(value, F.lit(default))
    joined = lambda *lists: F.nullif(F.array_join(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), " "), F.lit(""))

    def item(title: Column, content: Column, link: Column, published: Column, author: Column) -> Column:
        return F.struct(or_else(title, "No Title").alias("title"), or_else(content, "").alias("content"), or_else(link, "").alias("link"), or_else(published, "").alias("published"), or_else(author, "").alias("author"))

    def page(links: Column) -> Column:
        kept = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")).eqNullSafe("alternate") & F.coalesce(x["_type"], F.lit("text/html")).isin("text/html", "application/xhtml+xml"))
        return F.when(F.size(kept) > 0, F.element_at(kept, -1)["_href"])

    rss = F.transform("f.channel.item", lambda i: item(i["title"], F.coalesce(joined(i["content"], i["encoded"]), i["summary"], i["description"]), i["link"], F.coalesce(i["published"], i["pubDate"]), i["author"]))
    atom = F.transform("f.entry", lambda e: item(e["title"], F.coalesce(joined(e["content"]), e["summary"]), page(e["link"]), F.coalesce(e["published"], e["updated"]), e["author"]["name"]))
    rows = parsed.select("feed_id", or_else(F.coalesce("f.channel.title", "f.title"), "Unknown Feed").alias("feed_title"), F.posexplode(F.slice(F.coalesce(rss, atom), 1, most)).alias("place", "item"))
    return rows.select("feed_id", "feed_title", "place", "item.*")


def import_opml(outlines: DataFrame) -> DataFrame:
    """Feeds (name, url) of OPML documents (outline_id, xml): every outline of type rss with an address, at any depth; named by title, else text.

    A document that isn't well-formed has no feeds; a document type is left out, so none is fetched.
    """
    bare = outlines.select("outline_id", F.regexp_replace("xml", r"(?s)<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "").alias("xml"))
    # A malformed document comes back whole in ``broken``; XPath is only asked about the others.
    sound = bare.withColumn("p", F.from_xml("xml", "head string, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})).filter("p IS NOT NULL AND p.broken IS NULL").select("outline_id", "xml")
    own = "//outline[@type='rss' and string-length(@xmlUrl) > 0"
    kinds = {"title": "string-length(@title) > 0", "text": "string-length(@title) = 0 and string-length(@text) > 0"}
    lists = [F.arrays_zip(F.xpath("xml", F.lit(f"{own} and {test}]/@{name}")).alias("name"), F.xpath("xml", F.lit(f"{own} and {test}]/@xmlUrl")).alias("url")) for name, test in kinds.items()]
    unnamed = F.transform(F.xpath("xml", F.lit(f"{own} and string-length(@title) = 0 and string-length(@text) = 0]/@xmlUrl")), lambda u: F.struct(F.lit(None).cast("string").alias("name"), u.alias("url")))
    return sound.select("outline_id", F.inline(F.concat(*lists, unnamed)))


#: Schema of a raw post and what it becomes, by platform.
POSTS = {
    "twitter": ("id_str string, text string, created_at string, user struct<screen_name:string>", "text", "created_at", "format_string('https://twitter.com/%s/status/%s', user.screen_name, id_str)"),
    "telegram": ("id long, text string, date string, entity string", "text", "date", "format_string('t.me/%s/%s', ltrim('@', entity), id)"),
    "youtube": ("id string, title string, description string, published_at string", "concat(coalesce(title, ''), ' ', coalesce(description, ''))", "published_at", "format_string('https://www.youtube.com/watch?v=%s', id)"),
}


def ingest_posts(raw: DataFrame, kind: str) -> DataFrame:
    """Instances (raw_id, content, published, url) of raw posts (raw_id, json) of one platform; posts without content, and malformed ones, are left out."""
    schema, content, published, url = POSTS[kind]
    rows = raw.select("raw_id", F.from_json("json", schema).alias("p")).select("raw_id", "p.*")
    made = rows.selectExpr("raw_id", f"{content} AS content", f"{published} AS published", f"{url} AS url")
    return made.filter(F.trim("content") != "")


_COMMENT = "struct<id:string,text:string,author:string,publishedAt:string,likeCount:long,totalReplyCount:long>"


def post_comments(raw: DataFrame, most: int = 50) -> DataFrame:
    """Comments nested in raw videos (raw_id, json), a row each: place, comment_id, author, text, published, likes, replies; the first ``most`` of each."""
    listed = raw.select("raw_id", F.from_json("json", f"comments array<{_COMMENT}>")["comments"].alias("c"))
    rows = listed.select("raw_id", F.posexplode(F.slice("c", 1, most)).alias("place", "c"))
    return rows.select("raw_id", "place", F.col("c.id").alias("comment_id"), "c.author", "c.text", F.col("c.publishedAt").alias("published"), F.col("c.likeCount").alias("likes"), F.col("c.totalReplyCount").alias("replies"))


def prepare_web_content(pages: DataFrame, keywords: int = 10, summary: int = 500) -> DataFrame:
    """Pages (page_id, url, title, text, date) for analysis: cleaned text, a short summary, the most frequent words, an ISO date, and where it came from."""
    from storyweft.operators.text import _term_counts, _top

    own = pages.select(F.col("page_id").alias("narrative_id"), "text")
    top = _top(_term_counts(own, F.filter(words(F.col("text")), lambda w: F.length(w) >= 4)), keywords, "word")
    listed = top.groupBy(F.col("narrative_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("k"))  # ``keywords`` rows each
    rows = pages.join(listed, "page_id", "left")
    lineage = F.to_json(F.struct(F.col("url").alias("source"), F.length("text").alias("characters")))
    return rows.select("page_id", "title", clean_text(F.col("text")).alias("content"), truncated(F.col("text"), summary).alias("summary"), F.array_join(F.transform(F.coalesce("k", F.array().cast("array<struct<place:int,word:string>>")), lambda s: s["word"]), ",").alias("keywords"), normalize_date(F.col("date")).alias("published"), lineage.alias("lineage"))


def merge_source_lists(lists: list[DataFrame]) -> DataFrame:
    """Sources (name, url) of several lists in one: an address once, named as in the first list that has it."""
    numbered = [df.select("name", "url", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    place = F.row_number().over(Window.partitionBy("url").orderBy("list", "name"))
    return reduce(DataFrame.unionByName, numbered).withColumn("place", place).filter("place = 1").select("name", "url")


def complexity_profile(analyses: DataFrame) -> DataFrame:
    """Five scores of nested analysis documents (narrative_id, json); those without an overall score are left out."""
    score = "struct<score:double>"
    schema = f"overall_complexity_score double, linguistic_complexity {score}, logical_structure {score}, rhetorical_techniques {score}, emotional_manipulation {score}"
    rows = analyses.select("narrative_id", F.from_json("json", schema).alias("a")).filter("a.overall_complexity_score IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(f"a.{c}.score"), F.lit(0.0))
    return rows.select("narrative_id", F.col("a.overall_complexity_score").alias("overall"), zero("linguistic_complexity").alias("linguistic"), zero("logical_structure").alias("logical"), zero("rhetorical_techniques").alias("rhetorical"), zero("emotional_manipulation").alias("emotional"))


def evidence_points(narratives: DataFrame) -> DataFrame:
    """Texts of an evidence array (JSON of strings, or of objects with a text); the description where there are none."""
    raw = F.from_json("evidence", "array<string>")
    texts = F.filter(F.transform(raw, lambda e: F.when(F.ltrim(e).startswith("{"), F.get_json_object(e, "$.text")).otherwise(e)), lambda e: e.isNotNull())
    listed = F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, texts).otherwise(F.array("description"))
    return narratives.select("narrative_id", F.posexplode(listed).alias("place", "point"))
