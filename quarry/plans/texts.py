"""Queries of text, url and metadata functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..functions import urls as U
from .registry import query

#: SQL pieces that several queries share.
WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
PARTS = f"""p AS (SELECT page_id, url, html, regexp_extract(url, '{URL}', 1) AS scheme, lower(regexp_extract(url, '{URL}', 2)) AS host,
  regexp_extract(url, '{URL}', 3) AS path, regexp_extract(url, '{URL}', 4) AS query FROM pages),
n AS (SELECT *, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS bare FROM p),
d AS (SELECT *, lower(scheme) || '://' || host || bare AS dedup_url, scheme || '://' || host || bare || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS crawl_url FROM n)"""
BASE = "http://www.example.com/en"


@query("documents", sql=f"SELECT doc_id, substr(text, 1, 200) AS snippet, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_words, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def snippet_word_counts(documents):
    return documents.select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.word_count(F.col("text")).cast("long").alias("n_words"), T.line_count(F.col("text")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


@query("documents", sql=f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 121, 0) + 1, 680)) AS start FROM w)
SELECT doc_id, CAST(start // 680 AS INTEGER) AS chunk, sha256(array_to_string(t[start + 1 : start + 800], ' ')) AS chunk_sha256 FROM c""")
def chunk_fixed(documents):
    rows = documents.where("text is not null").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "words"))
    return rows.select("doc_id", "chunk", F.sha2("words", 256).alias("chunk_sha256"))


@query("pages", sql="""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)), ''),
  nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)), '')) AS title FROM pages""")
def page_title(pages):
    return pages.select("page_id", T.page_title(F.col("html")).alias("title"))


@query("pages", sql=f"WITH {PARTS} SELECT page_id, crawl_url, dedup_url FROM d")
def url_normalize(pages):
    return pages.select("page_id", U.crawl_form(F.col("url")).alias("crawl_url"), U.dedup_form(F.col("url")).alias("dedup_url"))


@query("pages", sql=f"WITH {PARTS} SELECT sha256(dedup_url) AS url_hash, min(page_id) AS page_id, count(*) AS n FROM d GROUP BY 1")
def url_hash(pages):
    return pages.select("page_id", U.url_hash(F.col("url")).alias("url_hash")).groupBy("url_hash").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("pages", sql=f"WITH {PARTS} SELECT page_id, concat_ws('_', nullif(substr(trim(regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 50), ''), substr(sha256(url), 1, 8)) AS slug FROM d")
def url_slug(pages):
    return pages.select("page_id", U.slug(F.col("url")).alias("slug"))


@query("pages", sql=f"""WITH {PARTS}, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM d)
SELECT page_id, host = 'www.example.com' AS same_host, regexp_extract(host, '[^.]*[.][^.]*$') = 'example.com' AS same_domain,
  host = 'www.example.com' AND starts_with(path, '/en') AS below,
  CAST(CASE WHEN host <> 'www.example.com' THEN 0 WHEN seg[1] = 'en' THEN len(seg) - 1 ELSE len(seg) END AS INTEGER) AS depth,
  regexp_extract(host, '[^.]*[.][^.]*$') = 'example.com' AND regexp_matches(url, '^http://[^?]*/e.*$') AND NOT regexp_matches(url, '^.*ref=x.*$') AS crawlable FROM s""")
def url_scope(pages):
    u, base = F.col("url"), F.lit(BASE)
    return pages.select(
        "page_id",
        U.in_scope(u, base, "hostname").alias("same_host"),
        U.in_scope(u, base, "domain").alias("same_domain"),
        U.in_scope(u, base, "subpages").alias("below"),
        U.depth(u, base).alias("depth"),
        U.crawlable(u, base, "domain", include=["http://*/e*"], exclude=["*ref=x*"]).alias("crawlable"),
    )


@query("pages", sql=f"""WITH {PARTS}, a AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'http://10.0.0.' || page_id % 200 || '/x' WHEN 2 THEN 'http://8.8.4.' || page_id % 200 || '/x'
  WHEN 3 THEN 'http://172.' || page_id % 40 || '.0.1/' ELSE 'ftp://' || host || '/' END AS address FROM d),
h AS (SELECT *, regexp_extract(address, '^[a-z]+://([^/?#]*)', 1) AS host FROM a)
SELECT page_id, address, (starts_with(address, 'http://') OR starts_with(address, 'https://')) AND host <> '' AND host <> 'localhost' AND NOT (regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')
  AND (starts_with(host, '10.') OR starts_with(host, '127.') OR starts_with(host, '192.168.') OR starts_with(host, '169.254.') OR starts_with(host, '0.')
  OR TRY_CAST(string_split(host, '.')[1] AS INTEGER) >= 224 OR (starts_with(host, '172.') AND TRY_CAST(string_split(host, '.')[2] AS INTEGER) BETWEEN 16 AND 31))) AS reachable FROM h""")
def ssrf_guard(pages):
    i = F.col("page_id") % 5
    n = (F.col("page_id") % 200).cast("string")
    address = (
        F.when(i == 0, F.col("url"))
        .when(i == 1, F.concat(F.lit("http://10.0.0."), n, F.lit("/x")))
        .when(i == 2, F.concat(F.lit("http://8.8.4."), n, F.lit("/x")))
        .when(i == 3, F.concat(F.lit("http://172."), (F.col("page_id") % 40).cast("string"), F.lit(".0.1/")))
        .otherwise(F.concat(F.lit("ftp://"), U.authority(F.col("url")), F.lit("/")))
    )
    return pages.select("page_id", address.alias("address")).withColumn("reachable", U.reachable(F.col("address")))


@query("pages", sql="""WITH h AS (SELECT page_id, html || '<a class=''x'' HREF=''q?a=1&amp;b=2''>x</a><a href=bare/' || page_id || '>y</a><abbr href="no">z</abbr><a href="#top">t</a>' AS html FROM pages),
f AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1) AS x FROM h),
l AS (SELECT page_id, list_distinct(list_filter(list_transform(x, lambda y: replace(regexp_replace(y, '^["'']|["'']$', '', 'g'), '&amp;', '&')), lambda y: y <> '' AND NOT regexp_matches(lower(y), '^(#|javascript:|mailto:|tel:|data:)'))) AS x FROM f)
SELECT page_id, unnest(x) AS link FROM l""")
def links_extract(pages):
    """Links of the pages and of three more forms: single quotes with an escaped sign, none, and another element."""
    more = F.concat("html", F.lit("<a class='x' HREF='q?a=1&amp;b=2'>x</a><a href=bare/"), F.col("page_id").cast("string"), F.lit('>y</a><abbr href="no">z</abbr><a href="#top">t</a>'))
    return pages.select("page_id", F.explode(U.links(more)).alias("link"))


@query("documents", sql="""WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS content_hash FROM (SELECT doc_id, CASE WHEN contains(text, '---') THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: trim(x) <> '---'
  AND len(list_filter(string_split(text, chr(10))[1:i], lambda y: trim(y) = '---')) % 2 = 0), chr(10)) ELSE text END AS text FROM documents) WHERE text IS NOT NULL)
SELECT content_hash, min(doc_id) AS doc_id, count(*) AS n FROM h GROUP BY 1""")
def content_hash_dedup(documents):
    rows = documents.where("text is not null").select("doc_id", U.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("pages", sql="SELECT page_id, url AS source_url, 'Page ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'f' || page_id || '.txt' END AS filename FROM pages")
def frontmatter_fields(pages):
    title = F.concat(F.lit("\ntitle: \"Page "), F.col("page_id").cast("string"), F.lit('"'))
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\nfilename: f"), F.col("page_id").cast("string"), F.lit(".txt"))).otherwise("")
    text = F.concat(F.lit("---\nsource_url: "), F.col("url"), title, name, F.lit("\n---\nbody source_url: none"))
    return pages.select("page_id", *(T.front_matter(text, f).alias(f) for f in ("source_url", "title", "filename")))


def _expand_sql(value: str) -> str:
    """Search terms of a value: words, then phrases, in order of first occurrence."""
    return f"""s AS (SELECT *, substr(lower(trim({value})), 1, 100) AS s FROM src),
a AS (SELECT *, CASE WHEN contains(translate(s, ';|/', ',,,'), ',') THEN list_filter(list_transform(string_split(translate(s, ';|/', ',,,'), ','), lambda x: trim(x)), lambda x: length(x) >= 3) ELSE [] END AS parts,
  list_filter(list_transform(string_split(regexp_replace(translate(s, ';|/,', '    '), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' '), lambda x: regexp_replace(x, '^[().''"]+|[().''"]+$', '', 'g')), lambda x: length(x) >= 3) AS tokens,
  regexp_extract(s, '\\b(1[89][0-9]{{2}}|20[0-9]{{2}})\\b', 1) AS year FROM s),
c AS (SELECT *, list_concat(parts, tokens, CASE WHEN year <> '' THEN [year] ELSE [] END, CASE WHEN s <> '' THEN [s] ELSE [] END) AS every FROM a),
d AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS terms FROM c),
e AS (SELECT *, list_concat(list_filter(terms, lambda x: NOT contains(x, ' ')), list_filter(terms, lambda x: contains(x, ' ')))[1:10] AS terms_out FROM d)"""


@query("part", sql=f"WITH src AS (SELECT p_partkey, p_name || '; ' || p_type || ' ' || (1890 + p_partkey % 200) AS v FROM part), {_expand_sql('v')} SELECT p_partkey, array_to_string(terms_out, '|') AS terms FROM e")
def expand_tokens(part):
    value = F.concat("p_name", F.lit("; "), "p_type", F.lit(" "), (F.lit(1890) + F.col("p_partkey") % 200).cast("string"))
    return part.select("p_partkey", F.array_join(M.expand(value), "|").alias("terms"))


@query("part", sql=f"""WITH src AS (SELECT DISTINCT p_brand, p_name AS v FROM part), {_expand_sql('v')},
u AS (SELECT p_brand, flatten(list(terms_out ORDER BY v)) AS t FROM e GROUP BY p_brand),
o AS (SELECT p_brand, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM u)
SELECT p_brand, array_to_string(list_concat(list_filter(t, lambda x: NOT contains(x, ' ')), list_filter(t, lambda x: contains(x, ' ')))[1:10], '|') AS terms FROM o""")
def normalize_list(part):
    return M.terms(part, "p_brand", "p_name").select("p_brand", F.array_join("terms", "|").alias("terms"))


def _metadata(documents, labels):
    """Metadata maps with an array of values for each key."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    tags = F.array("lang", "source", F.lit("text"), F.lit("body"))
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("none"))
    rows = documents.select("doc_id", "lang", "source").join(one, "doc_id", "left")
    return rows.select("doc_id", F.create_map(F.lit("filename"), F.array("source"), F.lit("tags"), tags, F.lit("quality"), F.array(quality)).alias("metadata"))


@query("documents", "labels", sql="""WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
m AS (SELECT d.doc_id, lang, source, coalesce(CAST(quality AS VARCHAR), 'none') AS quality FROM documents d LEFT JOIN q USING (doc_id))
SELECT doc_id, unnest(['filename', 'tags', 'quality']) AS key, unnest([source, lang || ',' || source || ',text', quality]) AS vals FROM m""")
def reduce_metadata_l2(documents, labels):
    rows = _metadata(documents, labels).select("doc_id", F.explode(M.reduce(F.col("metadata"), 2)).alias("key", "v"))
    return rows.select("doc_id", "key", F.array_join("v", ",").alias("vals"))


@query("documents", "labels", sql="SELECT doc_id, 'filename' AS key, source AS vals FROM documents")
def reduce_metadata_l3(documents, labels):
    rows = _metadata(documents, labels).select("doc_id", F.explode(M.reduce(F.col("metadata"), 3)).alias("key", "v"))
    return rows.select("doc_id", "key", F.array_join("v", ",").alias("vals"))


@query("events", sql="""SELECT event_id, unnest(['k', 'event_kind', 'filename']) AS key, unnest([json_extract_string(props, '$.k'), lower(event_type), 'x']) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def reserved_key_filter(events):
    raw = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Event Kind"), F.upper("event_type"), F.lit("filename"), F.lit("x"), F.lit("Chunk-Index"), F.lit("3"), F.lit("s3 uri"), F.lit("u"), F.lit("empty"), F.lit("  ")))
    return events.where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", F.explode(M.clean(raw)).alias("key", "value"))


@query("events", sql="""SELECT event_id, json_extract_string(props, '$.k') AS first_value, json_extract_string(props, '$.k') AS unquoted FROM events""")
def kb_scalar(events):
    k = F.get_json_object("props", "$.k")
    quoted = F.concat(F.lit('"'), k, F.lit('"'))
    return events.select("event_id", M.first_value(F.array(quoted, F.lit("other"))).alias("first_value"), M.unquote(quoted).alias("unquoted"))


@query("conversations", sql="""SELECT conv_id, turn, CASE WHEN length(text) > 20 THEN substr(text, 1, 10) || '...(' || length(text) || ' chars)' ELSE '***' END AS body, text, role FROM conversations""")
def mask_sensitive(conversations):
    return conversations.select("conv_id", "turn", M.masked(F.lit("request_body"), F.col("text")).alias("body"), M.masked(F.lit("text"), F.col("text")).alias("text"), M.masked(F.lit("role"), F.col("role")).alias("role"))


@query("part", sql="""WITH n AS (SELECT DISTINCT p_name AS name FROM part), k AS (SELECT unnest(['small rings', 'red widgit', 'blue bolt']) AS wanted)
SELECT * FROM (SELECT wanted, name, round(1 - levenshtein(wanted, name) / CAST(greatest(length(wanted), length(name)) AS DOUBLE), 6) AS similarity FROM k, n WHERE wanted <> name) WHERE similarity >= 0.7""")
def similarity_levenshtein(part):
    """Names like those asked for: a list of the caller, as literals, against each distinct name."""
    asked = F.explode(F.array(*map(F.lit, ["small rings", "red widgit", "blue bolt"])))
    rows = part.select(F.col("p_name").alias("name")).distinct().select(asked.alias("wanted"), "name").where("wanted <> name")
    return rows.withColumn("similarity", F.round(T.edit_similarity(F.col("wanted"), F.col("name")), 6)).where("similarity >= 0.7")


@query("events", sql="""WITH s AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS start FROM events WHERE value IS NOT NULL)
SELECT event_id, start // 60 || ':' || lpad(CAST(start % 60 AS VARCHAR), 2, '0') AS clock, 'media/' || event_id || '#t=' || start || CASE WHEN event_id % 2 = 0 THEN ',' || (start + 30) ELSE '' END AS url FROM s""")
def timestamp_display(events):
    rows = events.where("value is not null").select("event_id", F.floor(F.col("value") * 10).alias("start"))
    end = F.when(F.col("event_id") % 2 == 0, F.col("start") + 30)
    return rows.select("event_id", T.clock(F.col("start")).alias("clock"), T.fragment_url(F.concat(F.lit("media/"), F.col("event_id").cast("string")), F.col("start"), end).alias("url"))


@query("orders", sql="""WITH t AS (SELECT o_orderkey, CAST(o_orderkey % 37 + 1 AS BIGINT) AS total FROM orders)
SELECT o_orderkey, unnest(range(1, total + 1, 10)) AS first, least(unnest(range(1, total + 1, 10)) + 9, total) AS last FROM t""")
def page_ranges(orders):
    total = (F.col("o_orderkey") % 37 + 1).cast("long")
    return orders.select("o_orderkey", F.explode(T.page_ranges(total)).alias("r")).select("o_orderkey", "r.first", "r.last")


@query("conversations", sql="SELECT conv_id, turn, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(it|this|that|these|those|he|she|they|him|her|them)($|[^\\p{L}\\p{N}_])') AS ambiguous FROM conversations")
def ambiguous_queries(conversations):
    return conversations.select("conv_id", "turn", T.ambiguous(F.col("text")).alias("ambiguous"))


@query("documents", sql="""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'passthrough' WHEN 2 THEN 'media' WHEN 3 THEN 'ocr' ELSE 'ocr' END AS route, CASE doc_id % 5 WHEN 4 THEN 'noext' ELSE 'f' || doc_id END AS stem FROM documents""")
def file_routes(documents):
    i = F.col("doc_id") % 5
    ext = F.when(i == 0, ".csv").when(i == 1, ".md").when(i == 2, ".mp4").when(i == 3, ".pdf").otherwise("")
    name = F.concat(F.lit("a/b/"), F.when(i == 4, "noext").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"))), ext)
    return documents.select("doc_id", T.route(name).alias("route"), T.stem(name).alias("stem"))
