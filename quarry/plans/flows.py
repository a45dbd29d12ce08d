"""Queries of flows: views, texts for the index, context, seeds, page processing, retries, rebuilds and their tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import flows as W
from ..operators import retrieval as R
from .registry import query
from .texts import PARTS
from .vectors import K, SCORED, _vector

C = F.col


@query("pages", sql="""SELECT page_id, '---' || chr(10) || 'source_url: ' || url || chr(10) || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'title: "Page \\"' || page_id || '\\""' || chr(10) END || 'scraped_at: 2024-01-01' || chr(10) || '---' || chr(10) || 'body' AS markdown FROM pages""")
def scraped_front_matter(pages):
    title = F.when(C("page_id") % 3 > 0, F.concat(F.lit('Page "'), C("page_id").cast("string"), F.lit('"')))
    return pages.select("page_id", W.scraped(F.lit("body"), C("url"), title, F.lit("2024-01-01")).alias("markdown"))


@query("pages", sql="SELECT page_id, CASE page_id % 3 WHEN 0 THEN 't' || page_id WHEN 1 THEN url ELSE CAST(page_id AS VARCHAR) END AS filename FROM pages")
def scraped_filename(pages):
    i = C("page_id") % 3
    return pages.select("page_id", W.scraped_name(F.when(i == 0, F.concat(F.lit("t"), C("page_id"))).otherwise(""), F.when(i == 1, C("url")), C("page_id")).alias("filename"))


@query("conversations", sql="""SELECT conv_id, sha256(string_agg('--- Page ' || turn || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def pdf_page_blocks(conversations):
    pages = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return W.page_blocks(pages, "conv_id", "turn", "text").select("conv_id", F.sha2("text", 256).alias("text_sha256"))


@query("documents", sql="""WITH c AS (SELECT doc_id, source AS filename, CASE WHEN doc_id % 3 > 0 THEN 'seen ' || doc_id END AS u, CASE WHEN doc_id % 2 = 0 THEN 'made ' || lang END AS m FROM documents),
t AS (SELECT *, coalesce(u, '') || CASE WHEN u IS NOT NULL AND m IS NOT NULL THEN '. ' ELSE '' END || coalesce(m, '') AS c FROM c)
SELECT doc_id, '---' || chr(10) || 'image_id: ' || doc_id || chr(10) || coalesce('filename: ' || filename || chr(10), '') || 'type: image' || chr(10) || 'source_type: uploaded_image' || chr(10) || coalesce('user_caption: ' || u || chr(10), '') || coalesce('ai_caption: ' || m || chr(10), '')
  || '---' || chr(10) || chr(10) || CASE WHEN c <> '' AND filename IS NOT NULL THEN '# Image: ' || filename || chr(10) || chr(10) || c || chr(10) || chr(10) ELSE '' END || CASE WHEN u <> c THEN 'User description: ' || u || chr(10) || chr(10) ELSE '' END || CASE WHEN m <> c THEN 'AI description: ' || m || chr(10) || chr(10) ELSE '' END
  || '---' || chr(10) || 'Content type: image, picture, photo, photograph, visual, media, graphic, imagery' || chr(10) || 'This is a visual image file that can be viewed and displayed.' || chr(10) AS text FROM t""")
def image_index_text(documents):
    user = F.when(C("doc_id") % 3 > 0, F.concat(F.lit("seen "), C("doc_id")))
    made = F.when(C("doc_id") % 2 == 0, F.concat(F.lit("made "), C("lang")))
    return documents.select("doc_id", W.image_text(C("doc_id"), C("source"), user, made).alias("text"))


@query("orders", sql="""SELECT o_orderkey AS document_id, '' AS filename, upper(CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'ocr_complete' ELSE 'uploaded' END) AS status, 0 AS total_pages, o_orderdate AS shown_at,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 'out/' || o_orderkey END AS preview FROM orders""")
def document_views(orders):
    status = F.when(C("o_orderstatus") == "F", "indexed").when(C("o_orderstatus") == "O", "ocr_complete")
    none = lambda kind: F.lit(None).cast(kind)
    rows = orders.select(C("o_orderkey").alias("document_id"), none("string").alias("filename"), status.alias("status"), none("int").alias("total_pages"), none("date").alias("created_at"), C("o_orderdate").alias("updated_at"), F.concat(F.lit("out/"), C("o_orderkey")).alias("output_uri"))
    return W.view(rows)


@query("orders", sql="SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50) WHERE o_orderstatus = 'F'")
def native_page(orders):
    return W.native_page(orders, "o_orderkey", 100, 50, C("o_orderstatus") == "F").select("o_orderkey")


@query("customer", sql="SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b' ELSE '' END AS keys FROM customer")
def json_common_keys(customer):
    i, m = C("c_custkey") % 3, lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), F.lit("v"))))
    objects = F.when(i == 0, F.array(m("b", "a"), m("a", "b", "c"))).when(i == 1, F.array(m("a", "b"), m("b", "c"), m("b"))).otherwise(F.array(m("a"), m("b")))
    return customer.select("c_custkey", F.array_join(W.common_keys(objects), ",").alias("keys"))


@query("events", sql="SELECT event_id, NOT (event_id % 2 = 0 AND event_id % 4 IN (0, 1)) AS allowed FROM events")
def demo_features(events):
    feature = F.element_at(F.array(*map(F.lit, ["reprocess", "delete_documents", "search", "chat"])), (C("event_id") % 4 + 1).cast("int"))
    return events.select("event_id", W.allowed(feature, C("event_id") % 2 == 0).alias("allowed"))


@query("orders", sql="""SELECT o_orderkey, o_orderkey % 2 = 0 AS success, CAST(round(o_orderkey / 7.0, 2) AS DOUBLE) AS duration_ms, CASE WHEN o_orderkey % 2 = 1 THEN 500 END AS error_length FROM orders""")
def log_summaries(orders):
    odd = C("o_orderkey") % 2 == 1
    line = W.summary(F.lit("search"), ~odd, C("o_orderkey") / 7, F.lit(3), F.when(odd, F.repeat(F.lit("x"), 700)))
    row = F.from_json(line, "operation string, success boolean, duration_ms double, item_count int, error string")
    return orders.select("o_orderkey", row.alias("r")).select("o_orderkey", "r.success", "r.duration_ms", F.length("r.error").alias("error_length"))


@query("lineitem", sql="""SELECT l_linestatus AS context, l_returnflag AS model, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens, count(*) AS calls FROM lineitem GROUP BY ALL""")
def token_metering(lineitem):
    return W.metered(lineitem.select(C("l_linestatus").alias("context"), C("l_returnflag").alias("model"), C("l_partkey").alias("input_tokens"), C("l_suppkey").alias("output_tokens")))


@query("embeddings", sql=SCORED + f""", f AS (SELECT score FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT {K}), u AS (SELECT score FROM s ORDER BY score DESC, vec_id LIMIT {K})
SELECT round((SELECT count(*) FROM f) / CAST({K} AS DOUBLE), 4) AS fill_rate, round(coalesce((SELECT max(score) FROM f) / (SELECT max(score) FROM u), 0), 4) AS score_ratio, (SELECT count(*) FROM f) AS filtered_count, (SELECT count(*) FROM u) AS unfiltered_count""")
def slice_telemetry(embeddings):
    return W.slice_telemetry(R.slices(embeddings, "embedding", _vector(embeddings), K, C("label") == 3), K)


@query("documents", sql="""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 3 THEN 'document' ELSE 'media' END AS kind, CASE WHEN doc_id % 4 = 2 THEN 1 END AS segment, CASE WHEN doc_id % 5 > 0 THEN 'found' || doc_id ELSE '' END AS content FROM documents),
c AS (SELECT *, CASE WHEN kind = 'image' THEN 'caption ' || doc_id WHEN kind = 'media' THEN 'segment ' || coalesce(segment, 0) || ' of ' || doc_id END AS context FROM r)
SELECT doc_id AS document_id, CASE WHEN context IS NULL THEN content WHEN content = '' THEN context ELSE context || chr(10) || chr(10) || '[Visual match from: ' || content || ']' END AS content FROM c""")
def visual_context(documents):
    i, name = C("doc_id") % 4, lambda s: F.concat(F.lit(s), C("doc_id"))
    kind = F.when(i == 0, "image").when(i == 3, "document").otherwise("media")
    ids = documents.select("doc_id")
    results = ids.select(C("doc_id").alias("document_id"), F.lit("visual").alias("content_type"), kind.alias("kind"), F.when(i == 2, F.lit(1)).alias("segment"), F.when(C("doc_id") % 5 > 0, name("found")).otherwise("").alias("content"))
    images = ids.select(C("doc_id").alias("document_id"), name("caption ").alias("caption"))
    segments = ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("segment")).select(C("doc_id").alias("document_id"), "segment", F.concat(F.lit("segment "), "segment", F.lit(" of "), "doc_id").alias("text"))
    return W.with_visual_context(results, images, segments).select("document_id", "content")


@query("pages", sql="""WITH p AS (SELECT page_id, page_id // 20 AS job_id, url FROM pages), b AS (SELECT job_id, min_by(url, page_id) AS base_url FROM p WHERE page_id % 20 = 3 GROUP BY job_id),
s AS (SELECT p.job_id, min(page_id) AS seed_id FROM p JOIN b ON p.job_id = b.job_id AND p.url = b.base_url GROUP BY p.job_id)
SELECT p.page_id AS document_id, s.seed_id, CASE WHEN s.seed_id IS NOT NULL THEN 'topic ' || s.seed_id END AS seed_topic FROM p LEFT JOIN s USING (job_id)""")
def seed_documents(pages):
    rows = pages.select(C("page_id").alias("document_id"), F.expr("page_id div 20").alias("job_id"), C("url").alias("source_url"), F.concat(F.lit("topic "), "page_id").alias("topic"))
    jobs = rows.where("document_id % 20 = 3").select("job_id", C("source_url").alias("base_url"))
    return W.with_seed(rows, jobs, ["topic"]).select("document_id", "seed_id", "seed_topic")


@query("pages", sql=f"""WITH {PARTS}, r AS (SELECT page_id, page_id // 20 AS job_id, CASE WHEN page_id % 7 = 0 THEN 'FAILED' WHEN page_id % 5 = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status FROM d)
SELECT job_id, count_if(status <> 'FAILED') AS processed_count, count_if(status = 'FAILED') AS failed_count, count_if(status = 'SKIPPED') AS skipped_count FROM r GROUP BY job_id""")
def page_processing(pages):
    """Pages of which some failed and some are known with the same content; an address counts once for the state of knowledge."""
    rows = pages.select("page_id", F.expr("page_id div 20").alias("job_id"), F.concat("url", F.lit("/p"), "page_id").alias("url"), F.concat(F.lit("# Page\n\n"), "page_id").alias("markdown"), F.when(C("page_id") % 7 == 0, "timeout").alias("error"))
    from ..functions import urls as U

    known = rows.where("page_id % 5 = 0").select(U.url_hash(C("url")).alias("url_hash"), U.content_hash(C("markdown")).alias("content_hash"))
    known = known.union(rows.where("page_id % 5 = 1").select(U.url_hash(C("url")), F.sha2(F.lit("other"), 256)))
    return W.page_changes(rows, known)[1]


@query("customer", sql="""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level, CASE WHEN c_custkey % 6 = 5 THEN 'FAILED' ELSE 'INDEXED' END AS status FROM customer""")
def reduced_metadata_retry(customer):
    """Items whose metadata are accepted as they are, with lists of three, with core keys alone, or never."""
    i = C("c_custkey") % 3
    tags = F.transform(F.sequence(F.lit(1), F.when(i == 0, 2).otherwise(9)), lambda x: x.cast("string"))
    extra = F.when(i == 2, F.array(*map(F.lit, ["a", "b", "c"]))).otherwise(F.array(F.lit("a")))
    names = F.when(C("c_custkey") % 6 == 5, F.array(*map(F.lit, ["f", "g"]))).otherwise(F.array(F.lit("f")))
    rows = customer.select("c_custkey", F.create_map(F.lit("filename"), names, F.lit("tags"), tags, F.lit("extra"), extra).alias("metadata"))
    limit = F.when(i == 2, 1).otherwise(5)
    tried = lambda m: F.when(F.aggregate(F.map_values(m), F.lit(0), lambda s, v: s + F.size(v)) <= limit, "INDEXED").otherwise("FAILED")
    return W.ingested(rows, "metadata", tried).select("c_custkey", "level", "status")


@query("documents", sql="""WITH r AS (SELECT doc_id, doc_id // 10 AS batch, CASE WHEN text IS NULL OR doc_id % 11 = 0 THEN source || ': no text' END AS error FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id DESC, error DESC) AS k FROM r WHERE error IS NOT NULL)
SELECT r.batch, count(*) AS processed_count, count(error) AS error_count, coalesce((SELECT string_agg(k.error, ' | ' ORDER BY k.k) FROM k WHERE k.batch = r.batch AND k.k <= 5), '') AS last_errors FROM r GROUP BY r.batch""")
def rebuild_tallies(documents):
    content = documents.select(C("doc_id").alias("document_id"), C("source").alias("filename"), F.lit("document").alias("type"))
    texts = documents.where("doc_id % 11 <> 0").select(C("doc_id").alias("document_id"), "text")
    return W.rebuilt(content, texts)[1]


@query("orders", sql="""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'busy' WHEN o_orderkey % 2 = 0 THEN 'scraped' END AS refused, CASE WHEN o_orderstatus = 'P' THEN 'busy' END AS refused_reindex FROM orders""")
def reprocess_guard(orders):
    status, kind = F.when(C("o_orderstatus") == "P", "Transcribing").otherwise("indexed"), F.when(C("o_orderkey") % 2 == 0, "scraped")
    return orders.select("o_orderkey", W.may_reprocess(status, kind).alias("refused"), W.may_reprocess(status, kind, reindex=True).alias("refused_reindex"))


@query("lineitem", sql="SELECT DISTINCT l_orderkey AS document_id, 'content/' || l_orderkey || '/' || l_linenumber AS uri, l_linestatus = 'O' AS visual FROM lineitem")
def indexed_uris(lineitem):
    rows = lineitem.select(C("l_orderkey").alias("document_id"), F.concat_ws("/", F.lit("content"), C("l_orderkey").cast("string"), C("l_linenumber").cast("string")).alias("uri"), F.when(C("l_linestatus") == "O", "visual").otherwise("text").alias("content_type"))
    return W.indexed_uris(rows)
