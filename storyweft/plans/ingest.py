"""Queries of feeds, outlines, posts, pages and nested documents, each made from the supplied tables and parsed again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyweft.functions import text as X
from storyweft.operators import ingest as I
from storyweft.operators import publish as B
from storyweft.plans.joins import _COUNTERS, _counters
from storyweft.plans.registry import query
from storyweft.plans.texts import _clean, _w
from storyweft.sources.tables import Tables


def _escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _feeds(t: Tables):
    """A feed of every twenty documents; RSS and Atom in turn. Some items have no title, several contents or several links."""
    n = F.col("doc_id")
    text = lambda s: F.lit(s)
    title = F.when(n % 7 == 0, "").otherwise(F.concat(text("<title>"), _escaped(F.concat(F.lit("Story "), n, F.lit(" & "), "lang", F.lit(" <"), "source", F.lit(">"))), text("</title>")))
    link, body, day = F.concat(F.lit("https://posts.example.org/"), n), F.md5("text"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    contents = lambda name: F.when(n % 3 == 0, F.concat(text(f'<{name} type="html">'), body, text(f"</{name}><{name}>"), "lang", text(f"</{name}>"))).otherwise("")
    rss = F.concat(text("<item>"), title, text("<link>"), link, text("</link><description>"), body, text("</description>"), contents("content:encoded"), text("<pubDate>"), day, text("</pubDate><author>"), "lang", text("</author></item>"))
    links = F.concat(F.when(n % 2 == 0, text('<link rel="edit" href="https://edit.example.org/"/>')).otherwise(""), text('<link href="https://old.example.org/"/><link rel="alternate" type="text/html" href="'), link, text('"/><link rel="self" href="https://self.example.org/"/>'))
    atom = F.concat(text("<entry>"), title, links, text("<summary>"), body, text("</summary>"), contents("content"), text("<updated>"), day, text("</updated><author><name>"), "lang", text("</name></author></entry>"))
    rows = t.raw("documents").select(F.floor(n / 20).alias("feed_id"), n.alias("n"), rss.alias("rss"), atom.alias("atom"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda s: s[c]), "")
    made = rows.groupBy("feed_id").agg(joined("rss").alias("rss"), joined("atom").alias("atom"))  # twenty items each
    name = F.when(F.col("feed_id") % 5 == 0, "").otherwise(F.concat(F.lit("<title>Feed "), "feed_id", F.lit("</title>")))
    space = ' xmlns:content="http://purl.org/rss/1.0/modules/content/"'
    xml = F.when(F.col("feed_id") % 2 == 0, F.concat(text(f"<rss{space}><channel>"), name, "rss", text("</channel></rss>"))).otherwise(F.concat(text("<feed>"), name, "atom", text("</feed>")))
    return made.select("feed_id", xml.alias("xml"))


@query("s3_parse_feed_items", "SELECT doc_id // 20 AS feed_id, CASE WHEN doc_id // 20 % 5 = 0 THEN 'Unknown Feed' ELSE 'Feed ' || (doc_id // 20) END AS feed_title, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS INT) AS place, CASE WHEN doc_id % 7 = 0 THEN 'No Title' ELSE 'Story ' || doc_id || ' & ' || lang || ' <' || source || '>' END AS title, CASE WHEN doc_id % 3 = 0 THEN md5(text) || ' ' || lang ELSE md5(text) END AS content, 'https://posts.example.org/' || doc_id AS link, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published, lang AS author FROM documents QUALIFY place < 8")
def _(t: Tables):
    return I.parse_feed_items(_feeds(t), 8)


@query("s5_import_opml", "SELECT source_id // 20 AS outline_id, name || ' & co' AS name, 'https://feeds.example.org/' || source_id || '?a=1&b=2' AS url FROM sources WHERE source_id % 4 <> 3")
def _(t: Tables):
    n = F.col("source_id")
    kind = F.when(n % 4 == 3, "link").otherwise("rss")
    named = F.when(n % 2 == 0, F.lit("title")).otherwise(F.lit("text"))
    mark = F.when(n % 5 == 0, F.lit("'")).otherwise(F.lit('"'))
    tag = F.concat(F.lit("<outline type='"), kind, F.lit("' note='a > b' "), named, F.lit("="), mark, _escaped(F.concat("name", F.lit(" & co"))), mark, F.lit(' xmlUrl="'), _escaped(F.concat(F.lit("https://feeds.example.org/"), n, F.lit("?a=1&b=2"))), F.lit('"/>'))
    tags = t.sources.select(F.floor(n / 20).alias("outline_id"), tag.alias("tag")).groupBy("outline_id").agg(F.array_join(F.collect_list("tag"), "").alias("tags"))  # twenty each
    return I.import_opml(tags.select("outline_id", F.concat(F.lit('<opml version="2.0"><body><outline text="all">'), "tags", F.lit("</outline></body></opml>")).alias("xml")))


@query("s7_ingest_posts", "WITH c AS (SELECT conv_id * 100 + turn AS raw_id, conv_id, role, text, '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS published FROM conversations) SELECT raw_id, md5(CASE WHEN conv_id % 3 = 2 THEN role || ' ' || text ELSE text END) AS content, published, CASE conv_id % 3 WHEN 0 THEN 'https://twitter.com/' || role || '/status/' || raw_id WHEN 1 THEN 't.me/' || role || '/' || raw_id ELSE 'https://www.youtube.com/watch?v=' || raw_id END AS url FROM c WHERE conv_id % 3 = 2 OR trim(text) <> ''")
def _(t: Tables):
    rows = t.raw("conversations").withColumn("raw_id", F.col("conv_id") * 100 + F.col("turn")).withColumn("at", F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0")))
    made = (
        F.struct(F.col("raw_id").cast("string").alias("id_str"), "text", F.col("at").alias("created_at"), F.struct(F.col("role").alias("screen_name")).alias("user")),
        F.struct(F.col("raw_id").alias("id"), "text", F.col("at").alias("date"), F.concat(F.lit("@"), "role").alias("entity")),
        F.struct(F.col("raw_id").cast("string").alias("id"), F.col("role").alias("title"), F.col("text").alias("description"), F.col("at").alias("published_at")),
    )
    out = None
    for k, (kind, post) in enumerate(zip(I.POSTS, made, strict=True)):
        part = I.ingest_posts(rows.filter(F.col("conv_id") % 3 == k).select("raw_id", F.to_json(post).alias("json")), kind)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("content", F.md5("content"))


@query("s7_post_comments", "SELECT conv_id AS raw_id, CAST(turn - MIN(turn) OVER (PARTITION BY conv_id) AS INT) AS place, 'c' || turn AS comment_id, role AS author, text, '2024-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS published, turn * 2 AS likes, turn % 3 AS replies FROM conversations QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def _(t: Tables):
    """A conversation is a video whose turns are its comments."""
    turn = F.col("turn").cast("long")
    comment = F.struct("turn", F.concat(F.lit("c"), "turn").alias("id"), "text", F.col("role").alias("author"), F.concat(F.lit("2024-01-"), F.lpad((turn % 28 + 1).cast("string"), 2, "0")).alias("publishedAt"), (turn * 2).alias("likeCount"), (turn % 3).alias("totalReplyCount"))
    videos = t.raw("conversations").groupBy(F.col("conv_id").alias("raw_id")).agg(F.array_sort(F.collect_list(comment)).alias("comments"))  # the turns of one conversation
    return I.post_comments(videos.select("raw_id", F.to_json(F.struct("comments")).alias("json")), 4)


_PAGE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("s13_prepare_web_content", f"WITH p AS (SELECT page_id, {_PAGE} AS text FROM pages), w AS (SELECT page_id, unnest({_w('text')}) AS word FROM p), c AS (SELECT page_id, word, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY COUNT(*) DESC, word) AS k FROM w WHERE length(word) >= 4 GROUP BY 1, 2), g AS (SELECT page_id, string_agg(word, ',' ORDER BY k) AS words FROM c WHERE k <= 10 GROUP BY 1) SELECT page_id, md5({_clean('text')}) AS content, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END) AS summary, COALESCE(words, '') AS keywords, CASE WHEN page_id % 2 = 0 THEN '2024-03-04T00:00:00' ELSE 'soon' END AS published FROM p LEFT JOIN g USING (page_id)")
def _(t: Tables):
    date = F.when(F.col("page_id") % 2 == 0, "03/04/2024").otherwise("soon")
    pages = t.raw("pages").select("page_id", "url", X.page_title(F.col("html")).alias("title"), X.page_text(F.col("html")).alias("text"), date.alias("date"))
    return I.prepare_web_content(pages).select("page_id", F.md5("content").alias("content"), F.md5("summary").alias("summary"), "keywords", "published")


@query("s30_counter_bundle", f"""WITH {_COUNTERS}, p AS (SELECT narrative_id, counter_id FROM counters QUALIFY ROW_NUMBER() OVER (PARTITION BY narrative_id ORDER BY counter_id) <= 3), g AS (SELECT narrative_id, string_agg(CAST(counter_id AS VARCHAR), ',' ORDER BY counter_id) AS i FROM p GROUP BY 1) SELECT n.narrative_id, '{{"counters":[' || COALESCE(i, '') || '],"narrative_id":' || n.narrative_id || ',"status":"' || status || '"}}' AS document FROM narratives n LEFT JOIN g ON g.narrative_id = n.narrative_id""")
def _(t: Tables):
    return B.bundle(t.narratives.select("narrative_id", "status"), _counters(t).select("narrative_id", F.col("counter_id").alias("part_id")), "narrative_id", "counters", 3)


@query("s30_evidence_bundle", """SELECT page_id AS record_id, '{"type":"evidence_record","id":"evidence-' || page_id || '","hash":"' || sha256(html) || '","source_url":"' || url || '","capture_date":' || CASE WHEN page_id % 3 = 0 THEN 'null' ELSE '"2024-01-0' || (page_id % 9 + 1) || 'T00:00:00"' END || ',"content_type":"text/html","verified":' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"verification_method":null,"metadata":' || CASE WHEN page_id % 5 = 0 THEN '{}' ELSE '{"page":"' || page_id || '"}' END || ',"version":"1.0"' || CASE WHEN page_id % 4 = 0 THEN ',"content_data":"' || md5(html) || '"' ELSE '' END || '}' AS document FROM pages""")
def _(t: Tables):
    n = F.col("page_id")
    day = F.when(n % 3 != 0, F.concat(F.lit("2024-01-0"), n % 9 + 1)).cast("timestamp")
    meta = F.when(n % 5 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"page": '), n, F.lit("}")))
    records = t.raw("pages").select(n.alias("record_id"), F.sha2("html", 256).alias("content_hash"), F.col("url").alias("source_url"), day.alias("captured"), F.lit("text/html").alias("content_type"), (n % 2 == 0).alias("verified"), F.lit(None).cast("string").alias("verification_method"), meta.alias("metadata"), F.when(n % 4 == 0, F.md5("html")).alias("content_data"))
    return B.evidence_bundle(records)


@query("p4_complexity_profile", "SELECT narrative_id, overall, COALESCE(linguistic, 0) AS linguistic, COALESCE(logical, 0) AS logical, COALESCE(rhetorical, 0) AS rhetorical, COALESCE(emotional, 0) AS emotional FROM snapshots WHERE overall IS NOT NULL")
def _(t: Tables):
    score = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("score")))
    made = F.struct(F.col("overall").alias("overall_complexity_score"), score("linguistic").alias("linguistic_complexity"), score("logical").alias("logical_structure"), score("rhetorical").alias("rhetorical_techniques"), score("emotional").alias("emotional_manipulation"))
    return I.complexity_profile(t.snapshots.select("narrative_id", F.to_json(made).alias("json")))


@query("p20_evidence_points", "SELECT narrative_id, 0 AS place, 'first ' || narrative_id AS point FROM narratives WHERE narrative_id % 3 = 0 UNION ALL SELECT narrative_id, 1, 'second ' || language FROM narratives WHERE narrative_id % 3 = 0 UNION ALL SELECT narrative_id, 0, title FROM narratives WHERE narrative_id % 3 <> 0")
def _(t: Tables):
    n = F.col("narrative_id")
    made = F.when(n % 3 == 0, F.concat(F.lit('["first '), n, F.lit('", {"text": "second '), "language", F.lit('"}, {"note": "no text"}]'))).when(n % 3 == 1, F.lit("[]"))
    return I.evidence_points(t.narratives.select("narrative_id", made.alias("evidence"), F.col("title").alias("description")))


@query("e6_merge_source_lists", "WITH a AS (SELECT s_name AS name, 'u' || s_suppkey // 2 AS url, 0 AS l FROM supplier), b AS (SELECT c_name, 'u' || c_custkey, 1 FROM customer), m AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT name, url FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY url ORDER BY l, name) = 1")
def _(t: Tables):
    one = t.raw("supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("u"), F.floor(F.col("s_suppkey") / 2)).alias("url"))
    two = t.raw("customer").select(F.col("c_name").alias("name"), F.concat(F.lit("u"), "c_custkey").alias("url"))
    return I.merge_source_lists([one, two])
