"""Queries of catalogue operators, aggregates, windows, progress and quotas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import urls as U
from ..operators import catalog as C
from ..operators import crawl, keylib, media, progress
from .registry import query
from .texts import PARTS

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
DAY = "cast(ts as date)"


@query("documents", "pages", sql="""SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN 'side-' || d.doc_id END, p.url, CASE WHEN d.doc_id % 2 = 0 THEN 'front-' || d.doc_id END) AS source_url
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def source_resolution(documents, pages):
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string"))
    both = C.looked_up(documents.select("doc_id"), pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    side = F.when(F.col("doc_id") % 3 == 0, F.array(name("side-"), F.lit("x")))
    return both.select("doc_id", C.source_url(side, F.col("url"), F.when(F.col("doc_id") % 2 == 0, name("front-"))).alias("source_url"))


@query("documents", "pages", sql="""SELECT doc_id, CASE WHEN p.url IS NOT NULL AND d.lang = 'fr' THEN 'u/' || doc_id WHEN p.url IS NOT NULL THEN p.url WHEN doc_id >= 10000 THEN 's3://b/input/' || doc_id || '/' || doc_id ELSE 'u/' || doc_id END AS source_uri
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def citation_sources(documents, pages):
    results = documents.select("doc_id", "lang", F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("uri"))
    tracking = pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("input_uri")).join(documents.select("doc_id", F.when(F.col("lang") == "fr", "scraped").alias("type")), "doc_id")
    return C.citations(results, tracking, "doc_id", "b").select("doc_id", "source_uri")


@query("pages", sql=f"WITH {PARTS}, v AS (SELECT DISTINCT dedup_url FROM d WHERE page_id % 3 = 0) SELECT page_id FROM d WHERE dedup_url NOT IN (SELECT dedup_url FROM v)")
def visited_anti(pages):
    rows = pages.select("page_id", U.dedup_form(F.col("url")).alias("u"))
    return crawl.unvisited(rows, rows.where("page_id % 3 = 0"), ["u"]).select("page_id")


@query("documents", "labels", sql="SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def revoked_anti(documents, labels):
    return C.cascade({"chunks": documents.select("doc_id", "lang")}, labels.where("toxic = 1"), "doc_id")["chunks"]


@query("events", sql="SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(events):
    return C.latest(events, "user_id", ["ts", "event_id"], ["event_id", "event_type", "ts"])


@query("conversations", sql="SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def history_last5(conversations):
    return C.history(conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 5, F.col("role") != "system")


@query("conversations", sql="SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY conv_id")
def next_turn(conversations):
    return C.next_turn(conversations, "conv_id", "turn")


@query("conversations", sql="SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn % 3 = 1 AND conv_id % 4 <> 1)")
def ownership_visibility(conversations):
    owner = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("u"), (F.col("conv_id") % 4).cast("string")))
    return C.visible(conversations.withColumn("owner", owner), "conv_id", "owner", "u1").select("conv_id", "turn")


@query("region", sql="SELECT * FROM (VALUES ('color', 'blue'), ('size', '10'), ('theme', 'dark')) t(key, value)")
def config_overlay(region):
    default = F.create_map(F.lit("color"), F.lit("red"), F.lit("size"), F.lit("10"))
    custom = F.create_map(F.lit("color"), F.lit("blue"), F.lit("theme"), F.lit("dark"))
    return region.limit(1).select(F.explode(M.overlay(default, custom)).alias("key", "value"))


@query("documents", "pages", "embeddings", sql="""WITH m AS (SELECT doc_id AS id, 'document' AS type, 1 AS p, 0 AS n, n_chars AS created FROM documents
UNION ALL SELECT page_id, 'scrape', 2, 1, page_id FROM pages UNION ALL SELECT vec_id, 'image', 3, 2, CAST(label AS BIGINT) FROM embeddings WHERE vec_id % 2 = 0)
SELECT id, type, created FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, n DESC) = 1""")
def union_precedence(documents, pages, embeddings):
    row = lambda df, key, kind, created: df.select(F.col(key).alias("id"), F.lit(kind).alias("type"), F.col(created).cast("long").alias("created"))
    frames = [(row(documents, "doc_id", "document", "n_chars"), 1), (row(pages, "page_id", "scrape", "page_id"), 2), (row(embeddings.where("vec_id % 2 = 0"), "vec_id", "image", "label"), 3)]
    return C.precedence(frames, "id", "created")


@query("documents", sql="SELECT doc_id, lang FROM documents WHERE lang <> 'en' AND doc_id > 40 ORDER BY doc_id LIMIT 25")
def keyset_page(documents):
    return C.keyset_page(documents.where("lang <> 'en'").select("doc_id", "lang"), "doc_id", 40, 25)


@query("documents", sql="SELECT doc_id FROM documents ORDER BY lang, doc_id LIMIT 10 OFFSET 30")
def offset_batch(documents):
    return C.batch(documents.select("doc_id", "lang"), ["lang", "doc_id"], 10, 3).select("doc_id")


@query("documents", "labels", sql="""WITH s AS (SELECT doc_id, CASE WHEN max(quality) = 1 THEN 'INDEXED' ELSE 'FAILED' END AS state FROM labels GROUP BY doc_id)
SELECT d.doc_id AS document_id, CASE state WHEN 'INDEXED' THEN 'INDEXED' WHEN 'FAILED' THEN 'INGESTION_FAILED' ELSE 'SYNC_QUEUED' END AS status FROM documents d LEFT JOIN s USING (doc_id) WHERE lang = 'en'""")
def status_promote(documents, labels):
    uri = lambda c: F.concat(F.lit("out/"), F.col(c).cast("string"))
    states = labels.groupBy("doc_id").agg(F.when(F.max("quality") == 1, "INDEXED").otherwise("FAILED").alias("state")).select(uri("doc_id").alias("uri"), "state")
    rows = documents.select(F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "en", "SYNC_QUEUED").otherwise("DONE").alias("status"))
    return C.promoted(rows, states, uri("document_id"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'DONE' ELSE role END AS status FROM conversations")
def guarded_transition(conversations):
    return C.transition(conversations.withColumnRenamed("role", "status"), "status", ["user"], "DONE").select("conv_id", "turn", "status")


@query("documents", sql="SELECT CASE lang WHEN 'en' THEN 'document' WHEN 'fr' THEN 'image' ELSE 'scraped' END AS type, count(*) AS n FROM documents GROUP BY 1")
def content_counts(documents):
    kind = F.when(F.col("lang") == "en", F.lit(None)).when(F.col("lang") == "fr", "image").otherwise("scraped")
    return documents.groupBy(F.coalesce(kind, F.lit("document")).alias("type")).agg(F.count("*").alias("n"))


def _maps(events):
    return events.select("event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("x-amz-id"), F.lit("1"))).alias("m"))


@query("events", sql="""WITH e AS (SELECT event_id, unnest(['k', 'type']) AS key_name, unnest([json_extract_string(props, '$.k'), event_type]) AS v FROM events),
f AS (SELECT * FROM e WHERE v IS NOT NULL), s AS (SELECT key_name, v, min(event_id) AS o FROM f GROUP BY ALL),
t AS (SELECT key_name, string_agg(v, '|' ORDER BY o, v) AS samples, arg_min(v, o) AS head FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key_name ORDER BY o, v) <= 10) GROUP BY 1)
SELECT f.key_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS rate, CASE WHEN f.key_name = 'k' THEN 'number' ELSE 'string' END AS data_type, any_value(samples) AS samples FROM f JOIN t USING (key_name) GROUP BY f.key_name""")
def infer_type_profile(events):
    found = keylib.profile(_maps(events), "m", "event_id")
    return found.select("key_name", F.col("n").cast("long").alias("n"), "rate", "data_type", F.array_join("sample_values", "|").alias("samples"))


def _library(events):
    entries = events.select("event_type", "ts", F.explode(F.create_map(F.lit("type"), F.col("event_type"), F.col("event_type"), F.lit("1"))).alias("key", "value"))
    day = F.expr("ts < TIMESTAMP_NTZ'2024-01-08 00:00:00'")
    first, second = (keylib.observed(entries.where(c), "key", "value", "ts") for c in (day, ~day))
    return keylib.upserted(first.select("key_name", "data_type", "sample_values", "occurrence_count", "first_seen", "last_seen", "status"), second)


LIBRARY = """WITH e AS (SELECT ts, unnest(['type', event_type]) AS key_name FROM events),
lib AS (SELECT key_name, count(*) AS occurrence_count, min(ts) AS first_seen, max(ts) AS last_seen, 'active' AS status FROM e GROUP BY 1)
"""


@query("events", sql=LIBRARY + "SELECT * FROM lib")
def key_library_upsert(events):
    return _library(events).select("key_name", F.col("occurrence_count").cast("long").alias("occurrence_count"), "first_seen", "last_seen", "status")


@query("events", sql=LIBRARY + "SELECT count(*) AS total_keys, count(*) FILTER (key_name <> 'type') AS active_keys, count(*) FILTER (key_name = 'type') AS deprecated_keys, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM lib")
def library_stats(events):
    return keylib.stats(keylib.deprecated(_library(events), "type"))


@query("events", sql=LIBRARY + "SELECT key_name, occurrence_count FROM lib ORDER BY occurrence_count DESC, key_name")
def active_keys(events):
    return keylib.active(_library(events)).select("key_name", F.col("occurrence_count").cast("long").alias("occurrence_count"))


@query("part")
def similarity_ratcliff(part):
    return keylib.similar(part.select("p_name").distinct(), "small rings", 0.6, key="p_name")


def _words(events):
    return events.select("user_id", "event_id", "event_type", (F.col("event_id") % 1000).alias("start"))


@query("events", sql="""WITH w AS (SELECT user_id, event_id, event_type, event_id % 1000 AS s FROM events), n AS (SELECT user_id, CAST(greatest(1, ceil((max(s) + 1) / 30.0)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT user_id, least(s // 30, n - 1) AS i, string_agg(event_type, ' ' ORDER BY s, event_id) AS text, count(*) AS c FROM w JOIN n USING (user_id) GROUP BY ALL), e AS (SELECT user_id, unnest(range(0, n)) AS i FROM n)
SELECT user_id, i AS segment_index, i * 30 AS timestamp_start, i * 30 + 30 AS timestamp_end, coalesce(text, '') AS text, coalesce(c, 0) AS word_count FROM e LEFT JOIN g USING (user_id, i)""")
def segment_30s(events):
    return media.segments(_words(events), "user_id", "start", "event_type", ["start", "event_id"]).select("user_id", "segment_index", "timestamp_start", "timestamp_end", "text", "word_count")


@query("events", sql="""WITH c AS (SELECT user_id, event_type AS speaker, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, speaker FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def primary_speaker(events):
    return media.primary_speaker(events.select("user_id", "event_id", "event_type"), ["user_id"], "event_type", ["event_id"]).select("user_id", "speaker")


@query("events", sql="""WITH s AS (SELECT user_id, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS BIGINT) AS s FROM events)
SELECT user_id, s // 300 AS window_index, count(*) AS n, min(s) AS first, max(s) AS last FROM s GROUP BY ALL""")
def window_5min_groups(events):
    return media.groups(events.select("user_id", F.expr(SECONDS).alias("s")), ["user_id"], F.col("s"))


@query("lineitem", sql="""WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS page, string_agg(l_returnflag, chr(10) ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) AS text, round(avg(l_quantity), 6) AS confidence FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
b AS (SELECT l_orderkey, unnest(range(min(page), max(page) + 1)) AS page FROM p GROUP BY 1)
SELECT l_orderkey, page, coalesce(text, '') AS text, coalesce(confidence, 0.0) AS confidence FROM b LEFT JOIN p USING (l_orderkey, page)""")
def page_confidence(lineitem):
    rows = lineitem.where("l_linenumber % 2 = 1").withColumn("page", F.col("l_linenumber").cast("long"))
    return media.pages(rows, "l_orderkey", "page", ["l_partkey", "l_suppkey", "l_quantity"], "l_returnflag", "l_quantity").select("l_orderkey", "page", "text", F.round("confidence", 6).alias("confidence"))


@query("lineitem", sql="""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 9 ELSE 10 END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS o FROM lineitem),
r AS (SELECT *, sum(s) OVER w AS ok, sum(10 - s) OVER w AS bad, count(*) OVER (PARTITION BY l_orderkey) - count(*) OVER w AS remaining, 10 * count(*) OVER (PARTITION BY l_orderkey) AS total FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY o))
SELECT l_orderkey, l_linenumber, CAST(ok AS BIGINT) AS pages_succeeded, CAST(bad AS BIGINT) AS pages_failed, remaining, (total - bad) / total >= 0.95 AS can_reach,
CASE WHEN remaining = 0 THEN CASE WHEN ok / total >= 0.95 THEN 'COMPLETE' ELSE 'FAILED' END WHEN (total - bad) / total < 0.95 THEN 'UNREACHABLE' ELSE 'RUNNING' END AS state FROM r""")
def progress_threshold(lineitem):
    ok = F.when(F.col("l_returnflag") == "R", 9).otherwise(10)
    rows = lineitem.withColumn("ok", ok).withColumn("bad", 10 - F.col("ok"))
    out = progress.batches(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], "ok", "bad")
    return out.select("l_orderkey", "l_linenumber", "pages_succeeded", "pages_failed", "remaining", "can_reach", "state")


@query("orders", sql="""WITH c AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus = 'O') AS failed FROM orders GROUP BY 1)
SELECT o_custkey, total, processed, failed, total - processed - failed AS pending, round_even((processed + failed) / total * 100, 1) AS percent,
coalesce(failed / nullif(processed + failed, 0) > 0.1, false) AS too_many_failures, processed + failed >= total AS complete FROM c""")
def crawl_progress(orders):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("PENDING")
    return progress.crawl(orders.select("o_custkey", status.alias("status")), "o_custkey", "status")


@query("events", sql="""SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS used, row_number() OVER w <= 3 AS admitted, CAST(greatest(0, 3 - row_number() OVER w) AS INTEGER) AS remaining
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)""")
def quota_daily(events):
    rows = progress.quota(events.withColumn("day", F.expr(DAY)), ["user_id", "day"], ["ts", "event_id"], 3)
    return rows.select("event_id", "used", "admitted", "remaining")


@query("events", sql="""WITH u AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS mine FROM events),
g AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM u WHERE mine <= 3)
SELECT u.event_id, coalesce(g.k <= 100, false) AS admitted FROM u LEFT JOIN g USING (event_id)""")
def quota_coupled(events):
    return progress.coupled_quota(events.withColumn("day", F.expr(DAY)), "user_id", "day", ["ts", "event_id"], 3, 100).select("event_id", "admitted")


@query("pages", sql="""WITH RECURSIVE g AS (SELECT page_id AS src, (page_id * 7 + 3) % 250 AS dst FROM pages UNION SELECT page_id, (page_id * 3 + 1) % 400 FROM pages),
f(url, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT g.dst, f.depth + 1 FROM f JOIN g ON g.src = f.url WHERE f.depth < 4)
SELECT url, min(depth) AS depth FROM f GROUP BY url""")
def crawl_frontier(pages):
    one = pages.select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + 3) % 250).alias("dst"))
    two = pages.select(F.col("page_id").alias("src"), ((F.col("page_id") * 3 + 1) % 400).alias("dst"))
    return crawl.frontier(one.union(two), pages.where("page_id = 0").select(F.col("page_id").alias("url")), max_depth=4)


@query("pages")
def link_graph(pages):
    return crawl.link_graph(pages)


@query("events", sql="""WITH w AS (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS start, value FROM events)
SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def sliding_window(events):
    w = F.window("ts", "10 minutes", "5 minutes")
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


@query("events", sql="""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_window(events):
    return events.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(lineitem):
    return lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(lineitem):
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("events", sql="""SELECT event_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND (c.ts < e.ts OR (c.ts = e.ts AND c.event_id < e.event_id))
  AND c.ts = (SELECT max(d.ts) FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'click' AND (d.ts < e.ts OR (d.ts = e.ts AND d.event_id < e.event_id)))) AS click_id FROM events e WHERE event_type = 'error'""")
def asof_join(events):
    """The last click of the same user before each error: one window over the keys, no range join."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(F.col("event_type").isin("click", "error")).select("user_id", "ts", "event_id", "event_type")
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)
    return rows.withColumn("click_id", click).where("event_type = 'error'").select("event_id", "click_id")
