"""Queries of names, sidecars, listings, key library changes, media rows and guards, over what the tables themselves hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..functions import urls as U
from ..operators import catalog, crawl, keylib, media, retrieval
from ..operators.filters import compiled, names_only, validated
from ..session import scratch
from ..sources import files, keyed
from .registry import query

C = F.col


@query("documents", sql="""SELECT doc_id, lower(source) AS source, lower(lang) AS lang FROM documents""")
def sidecar_round_trip(documents):
    """Metadata as sidecar files beside each document, listed, read and joined back; every seventh letter count has none."""
    spark, folder = documents.sparkSession, scratch(documents.sparkSession, "sidecars")
    rows = documents.select("doc_id", F.concat(C("doc_id").cast("string"), F.lit(".md")).alias("uri"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata"))
    side = files.sidecars(rows, "uri", "metadata").repartition(keyed.folder(C("path"))).withColumn("path", keyed.spread(C("path")))
    keyed.write_keyed(side, folder, "path")
    back = files.texts(spark, folder).withColumn("path", F.element_at(F.split("path", "/"), -1))
    out = files.with_sidecars(rows.select("doc_id", "uri"), back, "uri")
    first = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0))
    return out.select("doc_id", first("source").alias("source"), first("lang").alias("lang"))


@query("documents", sql="""SELECT doc_id, octet_length(encode(text)) AS length FROM documents WHERE lang NOT IN ('de', 'es') AND octet_length(encode(text)) > 0""")
def listed_texts(documents):
    """A listing of what holds text: sidecars and images beside it are left out, and so are documents of no language, which are images too."""
    folder = scratch(documents.sparkSession, "listing")
    ending = F.when(C("lang") == "de", ".md.metadata.json").when(C("lang") == "es", ".JPG").when(C("lang").isNull(), ".png").otherwise(".md")
    rows = documents.select(F.concat(C("doc_id").cast("string"), ending).alias("key"), "text")
    keyed.write_keyed(rows.repartition(keyed.folder(C("key"))).withColumn("key", keyed.spread(C("key"))), folder, "key")
    return files.listed(documents.sparkSession, folder).select(F.regexp_extract("path", r"/(-?\d+)\.md$", 1).cast("long").alias("doc_id"), "length")


@query("pages", sql=r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://', 's3://') WHEN 1 THEN regexp_replace(url, '^https?://', 'https://s3.us-west-2.amazonaws.com/') ELSE url END AS uri FROM pages)
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN regexp_extract(uri, '^(?:s3://|https://s3\.us-west-2\.amazonaws\.com/)([^/]+)/?(.*)$', 1) END AS bucket, CASE WHEN page_id % 3 < 2 THEN regexp_extract(uri, '^(?:s3://|https://s3\.us-west-2\.amazonaws\.com/)([^/]+)/?(.*)$', 2) END AS key FROM u""")
def uri_parts(pages):
    i = C("page_id") % 3
    uri = F.when(i == 0, F.regexp_replace("url", "^https?://", "s3://")).when(i == 1, F.regexp_replace("url", "^https?://", "https://s3.us-west-2.amazonaws.com/")).otherwise(C("url"))
    parts = files.uri_parts(uri)
    return pages.select("page_id", parts["bucket"].alias("bucket"), parts["key"].alias("key"))


@query("documents", sql="""SELECT doc_id FROM documents WHERE (lang = 'fr' OR n_chars > 5000) AND source IS NOT NULL""")
def filter_validated(documents):
    """A filter with unknown keys, misplaced operators and empty branches, cleaned and compiled."""
    raw = {"$and": [{"$or": [{"lang": "FR"}, {"n_chars": {"$gt": 5000, "$near": 1}}, {"owner": "x"}, {}]}, {"source": {"$exists": True}}, {"$or": []}, {"$eq": 1}, "odd"], "size": {"$lt": 3}}
    clean = validated(raw, documents.columns)
    if names_only(raw, documents.columns) or not names_only(clean, documents.columns):
        raise ValueError("the filter was not cleaned")
    return documents.where(compiled(clean, documents.schema)).select("doc_id")


def _library(documents):
    """A key library: the sources with their counts, languages as samples and the time that the first id gives."""
    at = F.timestamp_seconds(C("doc_id"))
    entries = documents.where("source is not null and lang is not null").select("source", "lang", at.alias("at"))
    found = keylib.observed(entries, "source", "lang", "at")
    return documents.sparkSession.createDataFrame([], keylib.LIBRARY).unionByName(found.select(*[x.split()[0] for x in keylib.LIBRARY.split(", ")]))


_KEYS = "l AS (SELECT source AS key_name, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source)"


@query("documents", sql=f"""WITH {_KEYS}, m AS (SELECT unnest(['content_type', 'media_type', 'timestamp_start', 'timestamp_end', 'speaker', 'segment_index', 'duration_seconds']) AS key_name)
SELECT 'reset' AS step, key_name, 'active' AS status, CAST(0 AS BIGINT) AS n FROM l UNION ALL SELECT 'deactivated', key_name, CASE WHEN key_name IN ('src1', 'src2') THEN 'active' ELSE 'deprecated' END, 0 FROM l
UNION ALL SELECT 'deprecated', key_name, CASE WHEN key_name = 'src3' THEN 'deprecated' ELSE 'active' END, n FROM l UNION ALL SELECT 'without', key_name, 'active', n FROM l WHERE key_name <> 'src4'
UNION ALL SELECT 'seeded', key_name, 'active', n FROM l UNION ALL SELECT 'seeded', key_name, 'active', 0 FROM m UNION ALL SELECT 'again', key_name, 'active', 2 * n FROM l""")
def library_changes(documents):
    """A key library after each of its changes."""
    library = _library(documents)
    again = library.withColumn("occurrence_count", C("occurrence_count").cast("long"))
    steps = {
        "reset": keylib.reset(library),
        "deactivated": keylib.deactivated(keylib.reset(library), ["src1", "src2"]),
        "deprecated": keylib.deprecated(library, "src3"),
        "without": keylib.without(library, "src4"),
        "seeded": keylib.seeded(library, "2024-01-01"),
        "again": keylib.upserted(library, again),
    }
    out = None
    for name, rows in steps.items():
        part = rows.select(F.lit(name).alias("step"), "key_name", "status", C("occurrence_count").cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("documents", sql=f"""WITH {_KEYS}, p AS (SELECT 'lang' AS key_name UNION ALL SELECT 'source')
SELECT coalesce(l.key_name, p.key_name) AS key_name, CASE WHEN coalesce(l.key_name, p.key_name) IN ('lang', 'src5') THEN 'active' WHEN p.key_name IS NOT NULL THEN 'inactive' ELSE 'active' END AS status, coalesce(n, 0) AS n, p.key_name IS NOT NULL AS found FROM l FULL JOIN p ON l.key_name = p.key_name""")
def library_analysed(documents):
    """The library after an analysis of sampled metadata with a manual list of keys."""
    maps = documents.select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    out = keylib.analysed(_library(documents), keylib.profile(maps, "metadata", "doc_id"), ["lang", "src5"])
    return out.select("key_name", "status", C("occurrence_count").alias("n"), C("key_name").isin("lang", "source").alias("found"))


@query("documents", sql=f"""WITH {_KEYS}, s AS (SELECT source AS key_name, lang, min(doc_id) AS a FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang), f AS (SELECT key_name, arg_min(lang, (a, lang)) AS value FROM s GROUP BY key_name)
SELECT key_name, value FROM (SELECT key_name, value, row_number() OVER (ORDER BY n DESC, key_name) AS k FROM l JOIN f USING (key_name)) WHERE k <= 6""")
def filter_examples(documents):
    """Examples of filters over the most frequent keys."""
    made = [(next(iter(e["filter"])), next(iter(e["filter"].values()))["$eq"]) for e in keylib.filter_examples(_library(documents))]
    return documents.sparkSession.createDataFrame(made, "key_name string, value string")


@query("events", sql="""WITH w AS (SELECT user_id, event_id, CAST(value AS VARCHAR) AS start_time FROM events), l AS (SELECT start_time, arg_max('s' || user_id % 3, event_id) AS speaker FROM w WHERE user_id % 4 = 0 GROUP BY start_time)
SELECT event_id, speaker FROM w LEFT JOIN l USING (start_time)""")
def words_with_speakers(events):
    """Words and the speaker whose label has the same start, as text."""
    words = events.select("user_id", "event_id", C("value").cast("string").alias("start_time"))
    labels = words.where("user_id % 4 = 0").select("start_time", F.concat(F.lit("s"), C("user_id") % 3).alias("speaker"), C("event_id").alias("pos"))
    return media.timed(words, labels).select("event_id", "speaker")


@query("events", sql="""WITH w AS (SELECT user_id, event_id % 1000 // 30 AS i, event_type, event_id % 1000 * 100000000 + event_id AS m FROM events), k AS (SELECT user_id, i, event_type, count(*) AS c, min(m) AS f FROM w GROUP BY ALL),
p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY c DESC, f) = 1)
SELECT w.user_id, max(w.i) + 1 AS n_segments, (max(w.i) + 1) * 30 AS duration, (SELECT count(DISTINCT event_type) FROM p WHERE p.user_id = w.user_id) AS n_speakers FROM w GROUP BY w.user_id""")
def media_summary(events):
    """Segments, length and speakers of each medium."""
    words = events.select("user_id", "event_id", "event_type", (C("event_id") % 1000).alias("start"))
    made = media.segments(words, "user_id", "start", "event_type", ["start", "event_id"], speaker="event_type")
    return media.summary(made, "user_id").select("user_id", "n_segments", "duration", "n_speakers")


@query("documents", sql="""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL)
SELECT doc_id, avg(length(trim(line))) >= 50 AS is_text_native FROM l WHERE page <= 3 GROUP BY doc_id""")
def text_native(documents):
    """Whether the first three pages (lines here) of a document hold text enough."""
    pages = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "line")).withColumn("page", C("page") + 1)
    return media.text_native(pages, "doc_id", "page", "line")


@query("conversations", sql="SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*) AS n_parts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def combined_parts(conversations):
    """Partial files of a document in the order of their first pages."""
    return media.combined(conversations.where("text is not null"), "conv_id", "turn", "text")


@query("documents", sql="SELECT doc_id, greatest(30.0, n_chars * 10000 / CASE WHEN lang = 'en' THEN 1e6 ELSE 128e3 END) AS seconds FROM documents")
def duration_estimates(documents):
    return documents.select("doc_id", media.duration_estimate(C("n_chars") * 10000, C("lang") == "en").alias("seconds"))


@query("documents", sql=r"""WITH f AS (SELECT doc_id, n_chars, coalesce(substr(text, 1, 40), '') AS t FROM documents)
SELECT doc_id, CASE WHEN trim(regexp_replace(t, '[\x00-\x1f\x7f]', '', 'g')) = '' THEN 'unnamed' ELSE trim(regexp_replace(t, '[\x00-\x1f\x7f]', '', 'g')) END AS name,
  NOT regexp_matches(t, '[/\\"]') AND NOT contains(t, '..') AS name_ok, CASE WHEN trim(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) = '' THEN 'Untitled' ELSE substr(trim(regexp_replace(t, '[^\x00-\x7F]', '', 'g')), 1, 256) END AS title,
  CASE WHEN n_chars % 4 = 0 THEN CAST(n_chars // 4 AS VARCHAR) ELSE CAST(CAST(n_chars AS DOUBLE) / 4 AS VARCHAR) END AS number FROM f""")
def cleaned_names(documents):
    """Names, titles and numbers from the beginnings of texts."""
    start = F.coalesce(F.substring("text", 1, 40), F.lit(""))
    number = M.number(C("n_chars").cast("decimal(20,2)") / F.lit(4).cast("decimal(3,0)"))
    return documents.select("doc_id", M.filename(start).alias("name"), M.filename_ok(start).alias("name_ok"), M.ascii_title(start).alias("title"), number.alias("number"))


@query("documents", sql="""SELECT doc_id, concat_ws('. ', nullif(trim(substr(text, 1, n_chars % 3)), ''), nullif(trim(substr(text, 5, 10)), '')) AS caption, CASE WHEN source IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL THEN 0 ELSE 1 END AS attributes,
  substr(concat_ws(', ', source, lang, source, lang, source), 1, 100) AS first_value FROM documents""")
def captions_and_attributes(documents):
    """Captions of two parts, and metadata as inline attributes with five values at most."""
    listed = F.filter(F.array("source", "lang", "source", "lang", "source", "lang"), lambda x: x.isNotNull())
    attributes = M.inline(F.map_filter(F.create_map(F.lit("all"), listed, F.lit("none"), F.array().cast("array<string>"), F.lit("lang"), F.filter(F.array("lang"), lambda x: x.isNotNull())), lambda k, v: (k != "lang") | (F.size(v) > 0)))
    n = F.size(F.filter(F.array("source", "lang"), lambda x: x.isNotNull()))
    joined = F.get(F.filter(attributes, lambda a: a["key"] == "all"), F.lit(0))["value"]
    caption = M.caption(C("text").substr(F.lit(1), (C("n_chars") % 3).cast("int")), F.substring("text", 5, 10))
    return documents.select("doc_id", caption.alias("caption"), n.alias("attributes"), F.coalesce(joined, F.lit("")).alias("first_value"))


@query("pages", sql=r"""WITH t AS (SELECT page_id, html, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'))) AS n FROM pages)
SELECT page_id, CAST(n < 500 AS INT) + CAST(len(regexp_extract_all(html, '(?i)<script')) > 5 AS INT) + CAST(contains(html, 'ng-app') AS INT) >= 2 AS scripted, CASE WHEN CAST(n < 500 AS INT) + CAST(len(regexp_extract_all(html, '(?i)<script')) > 5 AS INT) + CAST(contains(html, 'ng-app') AS INT) >= 2 THEN 'rendered' ELSE 'plain' END AS source FROM
(SELECT page_id, html || CASE WHEN length(html) % 2 = 0 THEN '<i ng-app></i>' ELSE '' END AS html, n FROM t)""")
def scripted_pages(pages):
    """Pages, every second of which names an application, and what is read of them where there is a rendered form."""
    html = F.concat("html", F.when(F.length("html") % 2 == 0, "<i ng-app></i>").otherwise(""))
    rows = pages.select("page_id", html.alias("html"))
    return rows.select("page_id", crawl.is_scripted(C("html")).alias("scripted"), F.when(crawl.rendered(C("html"), F.lit("rendered")) == "rendered", "rendered").otherwise("plain").alias("source"))


@query("documents", sql=r"""WITH d AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, coalesce(text, '') AS t FROM documents), u AS (SELECT doc_id, t, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM d)
SELECT doc_id, id AS document_id, length(t) % 3 = 0 AS is_segment, length(t) % 3 <= 1 AS is_media, CASE length(t) % 3 WHEN 0 THEN CAST(length(t) AS BIGINT) WHEN 1 THEN CAST(length(t) * 10 // 1000 AS BIGINT) END AS timestamp_start,
  CASE WHEN length(t) % 3 = 0 THEN 's3://b/content/' || id || '/segment-' || length(t) || '.txt' ELSE id END AS dedup_key, true AS is_uuid, nullif(regexp_extract(t, '\b([0-9]{10,})\b', 1), '') AS number FROM u""")
def parsed_results(documents):
    """Search results by their addresses: segments, media and texts of documents."""
    h, n = F.md5(C("doc_id").cast("string")), F.length(F.coalesce("text", F.lit("")))
    uuid = F.concat_ws("-", *(F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rows = documents.select("doc_id", uuid.alias("_u"), n.alias("_n"), F.coalesce("text", F.lit("")).alias("_t"))
    tail = F.when(C("_n") % 3 == 0, F.concat(F.lit("/segment-"), C("_n").cast("string"), F.lit(".txt"))).otherwise("/text.md")
    rows = rows.withColumn("uri", F.concat(F.lit("s3://b/content/"), "_u", tail)).withColumn("content_type", F.when(C("_n") % 3 == 1, "audio").otherwise("document"))
    rows = rows.withColumn("timestamp_start", F.when(C("_n") % 3 == 0, C("_n").cast("string"))).withColumn("timestamp_millis", F.when(C("_n") % 3 == 1, (C("_n") * 10).cast("string")))
    out = retrieval.parsed(rows)
    return out.select("doc_id", "document_id", "is_segment", "is_media", "timestamp_start", "dedup_key", M.is_uuid(C("document_id")).alias("is_uuid"), T.numeric_id(C("_t")).alias("number"))


@query("conversations", sql="""WITH d AS (SELECT conv_id || '-' || turn AS message_id, conv_id * 100 + turn AS sent_at FROM conversations), k AS (SELECT *, row_number() OVER (ORDER BY sent_at, message_id) AS k FROM d)
SELECT message_id, CASE WHEN k <= 100 THEN sha256(message_id || '/replay') END AS dedup_id FROM k""")
def dead_letters_replayed(conversations):
    """The hundred oldest dead letters under new ids, and those that stay."""
    dead = conversations.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), (C("conv_id") * 100 + C("turn")).alias("sent_at"))
    again, rest = files.replayed(dead, 100)
    return again.select("message_id", "dedup_id").unionByName(rest.select("message_id", F.lit(None).cast("string").alias("dedup_id")))


@query("conversations", sql="""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations)
SELECT conv_id, turn FROM t WHERE role IS DISTINCT FROM old AND conv_id % 3 < 2""")
def changed_fields(conversations):
    """A log of turns, each with the one before it: those in which the role has changed, of inserts and updates alone."""
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    op = F.element_at(F.array(*map(F.lit, ["INSERT", "MODIFY", "REMOVE"])), (C("conv_id") % 3 + 1).cast("int"))
    log = conversations.select("conv_id", "turn", op.alias("op"), F.lit("turn").alias("key"), F.struct(C("role").alias("role")).alias("new"), F.struct(before.alias("role")).alias("old"))
    return files.changes(log, "turn", ["role"]).select("conv_id", "turn")


@query("events", sql="""SELECT event_id, event_type AS status, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS owner FROM events WHERE props IS NOT NULL""")
def finished_jobs(events):
    """Workflow results: JSON inside JSON."""
    # the id travels inside the output, for the parsed columns alone come back
    output = F.to_json(F.struct(C("user_id").alias("owner"), C("event_id").alias("id")))
    detail = F.to_json(F.struct(C("event_type").alias("status"), C("props").alias("input"), output.alias("output")))
    out = files.finished_jobs(events.where("props is not null").select(detail.alias("detail")))
    at = lambda c, path: F.try_variant_get(c, path, "bigint")
    return out.select(at("output", "$.id").alias("event_id"), "status", at("input", "$.k").alias("k"), at("output", "$.owner").alias("owner"))


@query("orders", "customer", sql="""SELECT o_orderkey, coalesce(c_mktsegment, 'UNKNOWN') AS segment, o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY AS recent, o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus <> 'F' AS allowed
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def looked_up_guards(orders, customer):
    """A lookup with a default, a date range and the access rule."""
    from datetime import datetime

    table = customer.where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("segment"))
    out = catalog.looked_up(orders, table, "o_custkey", {"segment": "UNKNOWN"})
    kind = F.when(C("o_orderpriority") == "1-URGENT", "user").when(C("o_orderpriority") == "2-HIGH", "api_key").otherwise("anonymous")
    recent = catalog.within(C("o_orderdate"), datetime(1998, 6, 1), 30)
    return out.select("o_orderkey", "segment", recent.alias("recent"), catalog.may_access(kind, C("o_orderstatus") != "F").alias("allowed"))


@query("pages", sql="""WITH p AS (SELECT page_id, url, sha256(html) AS h FROM pages), k AS (SELECT page_id + 1 AS page_id, sha256(html) AS h FROM pages UNION ALL SELECT page_id, sha256(html) FROM pages WHERE page_id = 0)
SELECT p.page_id FROM p LEFT JOIN (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN h ELSE (SELECT h FROM p q WHERE q.page_id = k.page_id) END AS h FROM k WHERE page_id % 3 < 2) k USING (page_id) WHERE k.h IS NULL OR k.h <> p.h""")
def changed_pages(pages):
    """Pages whose content is not the one known: unknown ones, and those known with their neighbour's content."""
    now = pages.select("page_id", U.content_hash(C("html")).alias("_u"), F.sha2("html", 256).alias("h"))
    neighbour = pages.select((C("page_id") + 1).alias("page_id"), F.sha2("html", 256).alias("h")).unionByName(pages.where("page_id = 0").select("page_id", F.sha2("html", 256).alias("h")))
    known = neighbour.where("page_id % 3 < 2").join(now.select("page_id", C("h").alias("_own")), "page_id", "left").select("page_id", F.when(C("page_id") % 2 == 0, C("h")).otherwise(C("_own")).alias("h"))
    return catalog.changed(now.drop("_u"), known, "page_id", "h").select("page_id")


@query("documents", sql="""SELECT doc_id, list_sort(list_filter([source, lang], lambda x: x NOT IN ('src1', 'src2', 'en', 'fr'))) AS unknown FROM documents""")
def unknown_settings(documents):
    """Keys that a configuration does not have, sorted."""
    given = F.map_from_arrays(F.array_distinct(F.filter(F.array("source", "lang"), lambda x: x.isNotNull())), F.transform(F.array_distinct(F.filter(F.array("source", "lang"), lambda x: x.isNotNull())), lambda x: F.lit(1)))
    return documents.select("doc_id", F.array_sort(catalog.unknown_keys(given, ["src1", "src2", "en", "fr"])).alias("unknown"))


@query("documents", sql="""SELECT doc_id, CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || chr(10) || '[truncated]' ELSE text END AS prompt, regexp_replace(source || '.v1.' || lang, '[.][^.]*$', '') AS stem FROM documents""")
def truncated_prompts(documents):
    name = F.concat_ws("/", F.lit("a.b"), F.concat("source", F.lit(".v1."), "lang"))
    return documents.select("doc_id", T.truncated(C("text"), 8000).alias("prompt"), F.when(C("source").isNotNull() & C("lang").isNotNull(), T.stem(name)).alias("stem"))


@query("documents", sql="""WITH r AS (SELECT doc_id, 'f' || length(coalesce(text, '')) || '.' || (['png', 'JPG', 'txt', 'webp'])[n_chars % 4 + 1] AS name, CASE n_chars % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' END AS kind, length(coalesce(text, '')) * 4000 AS size, n_chars % 4 AS e FROM documents)
SELECT doc_id, CASE WHEN e = 2 THEN 'unsupported extension' WHEN kind = 'text/html' THEN 'unsupported type' WHEN size <= 0 THEN 'empty' WHEN size > 10485760 THEN 'too large' END AS problem FROM r""")
def image_problems(documents):
    n = F.length(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("f"), n.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ["png", "JPG", "txt", "webp"])), (C("n_chars") % 4 + 1).cast("int")))
    kind = F.when(C("n_chars") % 3 == 0, "image/png").when(C("n_chars") % 3 == 1, "text/html")
    return documents.select("doc_id", files.image_problem(kind, name, n * 4000).alias("problem"))


@query("documents", sql=r"""WITH d AS (SELECT doc_id, coalesce(length(text), 0) % 4 AS k, regexp_replace(coalesce(substr(text, 1, 300), ''), '[\n#-]', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN nullif(trim(substr(t, 1, 50)), '') WHEN 1 THEN coalesce(nullif(trim(substr(t, 60, 20)), ''), nullif(substr(trim(t), 1, 200), '')) WHEN 2 THEN nullif(substr(trim(t), 1, 200), '') END AS caption,
  'f' || doc_id || '.' || (['PDF', 'md', 'tar.gz', ''])[k + 1] AS filename, lower((['PDF', 'md', 'gz', ''])[k + 1]) AS file_type FROM d""")
def image_captions(documents):
    """Captions of index texts made of the beginnings of documents: named in the front matter, in the body, or not at all; and names of their files."""
    k = F.coalesce(F.length("text"), F.lit(0)) % 4
    t = F.regexp_replace(F.coalesce(F.substring("text", 1, 300), F.lit("")), "[\\n#-]", " ")
    head, body = F.lit("---\nimage_id: 1\n"), F.concat(F.lit("---\n# Image\n\n"), t)
    text = F.when(k == 0, F.concat(head, F.lit("user_caption: "), F.substring(t, 1, 50), F.lit("\nai_caption: \n---\n"))).when(k == 1, F.concat(head, F.lit("ai_caption: "), F.substring(t, 60, 20), F.lit("\n"), body)).when(k == 2, F.concat(head, body)).otherwise(t)
    uri = F.concat(F.lit("s3://b/x/f"), C("doc_id"), F.lit("."), F.element_at(F.array(*map(F.lit, ["PDF", "md", "tar.gz", ""])), (k + 1).cast("int")))
    return documents.select("doc_id", T.image_caption(text).alias("caption"), T.file_of(uri).alias("filename"), T.file_type(T.file_of(uri)).alias("file_type"))


@query("documents", sql=f"""WITH {_KEYS}, s AS (SELECT source AS key_name, lang, min(doc_id) AS a FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang), v AS (SELECT key_name, list(lang ORDER BY a, lang)[1:3] AS v FROM s GROUP BY key_name),
k AS (SELECT * FROM (VALUES (0, 'src1'), (1, 'src_2'), (2, 'src7'), (3, 'new_key')) k(pos, key_name))
SELECT k.pos, k.key_name, '  - ' || k.key_name || CASE WHEN v.v IS NOT NULL THEN ': e.g., "' || array_to_string(v.v, '", "') || '"' ELSE '' END AS example FROM k LEFT JOIN v USING (key_name)""")
def manual_key_examples(documents):
    """Manual keys under their normalised names, with values of the library's keys."""
    return keylib.manual_examples(_library(documents), ["SRC1", "src 2", "Src7", "New-Key"])


@query("documents", sql=f"""WITH {_KEYS} SELECT source AS key_name, n, (SELECT epoch_us(to_timestamp(max(doc_id))) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) AS last_us, row_number() OVER (ORDER BY n DESC, source) AS pos FROM (SELECT key_name AS source, n FROM l)""")
def library_view(documents):
    """All keys of the library in the order of the statistics page."""
    from pyspark.sql import Window

    view = keylib.stats_view(_library(documents))
    pos = F.row_number().over(Window.orderBy(F.desc("occurrence_count"), "key_name"))
    return view.select("key_name", C("occurrence_count").alias("n"), F.unix_micros("last_analyzed").alias("last_us"), pos.cast("long").alias("pos"))


@query("embeddings", "documents", sql="""WITH p AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS query, CAST(embedding AS DOUBLE[]) AS w FROM embeddings QUALIFY query < 5), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query, vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS score FROM e, p), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 100),
u AS (SELECT DISTINCT vec_id FROM r), m AS (SELECT vec_id, lang, source FROM u JOIN documents ON doc_id = vec_id), c AS (SELECT count(*) AS vectors_sampled FROM u)
SELECT k.key_name, vectors_sampled, 2 AS keys_analyzed, k.n_values FROM (SELECT 'lang' AS key_name, least(count(DISTINCT lang), 10) AS n_values FROM m UNION ALL SELECT 'source', least(count(DISTINCT source), 10) FROM m) k, c""")
def analyse_entry(embeddings, documents):
    """The index sampled by probes, the metadata of what they found profiled, and the library after it."""
    from .vectors import _probes

    vectors = embeddings.select("vec_id", "embedding", F.concat(F.lit("u"), C("vec_id")).alias("uri"))
    found = retrieval.probed(vectors, "embedding", _probes(embeddings), 10_000)
    maps = documents.select(C("doc_id").alias("vec_id"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    library, counts = keylib.analyse(found.join(maps, "vec_id", "left"), documents.sparkSession.createDataFrame([], keylib.LIBRARY), "metadata", "vec_id")
    return library.select("key_name", F.size("sample_values").cast("long").alias("n_values")).join(counts).select("key_name", "vectors_sampled", C("keys_analyzed").cast("int").alias("keys_analyzed"), "n_values")


@query("documents", sql="""WITH d AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, n_chars % 4 AS k, n_chars, lang, source FROM documents), u AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM d),
f AS (SELECT *, 's3://b/content/' || id || CASE k WHEN 0 THEN '/segment-' || n_chars || '.txt' ELSE '/text.md' END AS uri, (['media', 'scraped', 'image', 'document'])[k + 1] AS type FROM u)
SELECT doc_id AS rank, 'c' AS content, CASE WHEN k = 1 THEN uri ELSE 's3://b/input/' || doc_id END AS source, CAST(0.5 AS DOUBLE) AS score, id AS document_id, source AS filename, CASE WHEN k = 1 THEN 'http://' || doc_id ELSE 's3://b/input/' || doc_id END AS document_url, true AS document_access_allowed,
  k = 1 AS is_scraped, CASE WHEN k = 1 THEN 'http://' || doc_id END AS source_url, k = 2 AS is_image, CASE WHEN k = 2 THEN 's3://b/input/' || doc_id END AS thumbnail_url, k = 0 AS is_media, CASE WHEN k = 0 THEN 'video' END AS media_type, k = 0 AS is_segment,
  CASE WHEN k = 0 THEN 's3://b/input/' || doc_id || '#t=' || n_chars END AS segment_url, CASE WHEN k = 0 THEN n_chars END AS timestamp_start, coalesce(lang = 'de', false) AS is_visual_match FROM f""")
def search_response(documents):
    """The answer of a search over results of four kinds."""
    h, k = F.md5(C("doc_id").cast("string")), C("n_chars") % 4
    uuid = F.concat_ws("-", *(F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    tail = F.when(k == 0, F.concat(F.lit("/segment-"), "n_chars", F.lit(".txt"))).otherwise("/text.md")
    rows = documents.select("doc_id", uuid.alias("_u"), "n_chars", "lang", "source", k.alias("k"), tail.alias("_tail"))
    results = rows.select(C("doc_id").alias("rank"), F.concat(F.lit("s3://b/content/"), "_u", "_tail").alias("uri"), F.lit("c").alias("content"), F.lit(0.5).alias("score"), F.when(C("lang") == "de", "visual").otherwise("text").alias("content_type"), F.when(C("k") == 0, C("n_chars").cast("string")).alias("timestamp_start"))
    kinds = F.element_at(F.array(*map(F.lit, ["media", "scraped", "image", "document"])), (C("k") + 1).cast("int"))
    tracked = rows.select(C("_u").alias("document_id"), C("source").alias("filename"), kinds.alias("type"), F.when(C("k") == 1, F.concat(F.lit("http://"), "doc_id")).alias("source_url"), F.lit("video").alias("media_type"), F.concat(F.lit("s3://b/input/"), "doc_id").alias("input_uri"))
    return retrieval.response(results, tracked)
