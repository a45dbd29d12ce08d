"""Queries of vector retrieval over `embeddings`; the query vector is that of vec_id 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chat
from ..operators import retrieval as R
from ..operators.filters import compiled
from .registry import query

K = 10
SCORED = """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, label, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS score FROM e, q)
"""


def _merged_sql(condition: str, ceiling: float) -> str:
    return (
        SCORED
        + f""", f AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS pos FROM s WHERE {condition} QUALIFY pos <= {K}),
u AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS pos FROM s QUALIFY pos <= {K}),
b AS (SELECT CASE WHEN max(f.score) IS NULL OR max(f.score) <= 0 OR (SELECT max(score) FROM u) IS NULL THEN {ceiling}
  ELSE least(greatest((SELECT max(score) FROM u) / max(f.score) * 1.05, 1.02), {ceiling}) END AS boost FROM f),
m AS (SELECT vec_id, label, 'filtered' AS slice, pos, round(score * boost, 6) AS score FROM f, b
  UNION ALL SELECT vec_id, label, 'unfiltered', pos, score FROM u),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, slice, pos) = 1)
SELECT vec_id, label, slice, score, CAST(row_number() OVER (ORDER BY score DESC, slice, pos) AS INTEGER) AS rank FROM d QUALIFY rank <= {2 * K}"""
    )


def _vector(embeddings: DataFrame) -> list[float]:
    """The query vector: one row."""
    return [float(x) for x in embeddings.where("vec_id = 0").select("embedding").first()[0]]


def _search(embeddings: DataFrame, condition: dict | None, ceiling: float = R.CEILING) -> DataFrame:
    predicate = None if condition is None else compiled(condition, embeddings.schema)
    return R.multislice(embeddings, "embedding", _vector(embeddings), K, predicate, ceiling).select("vec_id", "label", "slice", "score", "rank")


def _plain(embeddings: DataFrame, k: int = K) -> DataFrame:
    return R.multislice(embeddings, "embedding", _vector(embeddings), k).select("vec_id", "label", "score", "rank")


@query("embeddings", sql=SCORED + f"SELECT vec_id, label, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {K}")
def vector_topk(embeddings):
    return _plain(embeddings)


@query("embeddings", sql=_merged_sql("label = 3", 1.25))
def multislice_boost(embeddings):
    return _search(embeddings, {"label": {"$eq": 3}})


@query("embeddings", sql=_merged_sql("label = 1000", 1.25))
def multislice_boost_empty_filter(embeddings):
    return _search(embeddings, {"label": 1000})


@query("embeddings", sql=_merged_sql("label IN (2, 4)", 1.01))
def multislice_boost_low_ceiling(embeddings):
    return _search(embeddings, {"label": {"$in": [2, 4]}}, ceiling=1.01)


@query("embeddings", sql=SCORED + """, m AS (SELECT label, vec_id, score FROM s WHERE label < 5 UNION ALL SELECT label, vec_id, score FROM s WHERE label > 2),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1)
SELECT label, vec_id, score FROM d""")
def slice_dedup(embeddings):
    scored = embeddings.select("vec_id", "label", R.cosine("embedding", _vector(embeddings)).alias("score"))
    both = scored.where("label < 5").unionByName(scored.where("label > 2"))
    return R.best_per_key(both, "label", pos="vec_id").select("label", "vec_id", "score")


@query("embeddings", "documents", sql=SCORED + f""", t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K})
SELECT t.vec_id, CAST(t.rank AS INTEGER) AS rank, t.score, d.source, d.lang, CASE WHEN d.lang = 'fr' THEN 'scraped' ELSE 'document' END AS type, substr(d.text, 1, 200) AS snippet
FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id""")
def search_enriched(embeddings, documents):
    kind = F.when(F.col("lang") == "fr", "scrape")
    catalogue = documents.select(F.col("doc_id").alias("vec_id"), "source", "lang", kind.alias("type"), F.substring("text", 1, 200).alias("snippet"))
    return R.enriched(_plain(embeddings).drop("label"), catalogue, "vec_id").select("vec_id", "rank", "score", "source", "lang", "type", "snippet")


@query("embeddings", "documents", sql=SCORED + """, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)
SELECT string_agg('[Source: ' || coalesce(d.source, 'unknown') || ']' || chr(10) || coalesce(substr(d.text, 1, 200), ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY t.rank) AS context, count(*) AS n_chunks
FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id""")
def context_assembly(embeddings, documents):
    catalogue = documents.select(F.col("doc_id").alias("vec_id"), "source", F.substring("text", 1, 200).alias("snippet"))
    return R.context(R.enriched(_plain(embeddings), catalogue, "vec_id"), "snippet", "source")


@query("embeddings", "documents", sql=SCORED + """, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
r AS (SELECT vec_id AS doc_id, 'content/' || vec_id || '/text' AS uri, score, rank FROM t),
n AS (SELECT doc_id, 'content/' || doc_id || '/text' AS uri FROM documents WHERE contains('scan-' || (1000000000 + doc_id // 4) || '.pdf', '1000000007') ORDER BY doc_id LIMIT 3),
m AS (SELECT doc_id, uri, CAST(1.0 AS DOUBLE) AS score, 0 AS back, row_number() OVER (ORDER BY doc_id DESC) AS spot FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE contains(uri, '1000000007'))
  UNION ALL SELECT doc_id, uri, score, 1, rank FROM r)
SELECT doc_id, uri, score, CAST(row_number() OVER (ORDER BY back, spot) AS INTEGER) AS rank FROM m""")
def id_fallback(embeddings, documents):
    uri = lambda c: F.concat(F.lit("content/"), F.col(c).cast("string"), F.lit("/text")).alias("uri")
    results = _plain(embeddings, 5).select(F.col("vec_id").alias("doc_id"), uri("vec_id"), "score", "rank")
    name = F.concat(F.lit("scan-"), (F.lit(1000000000) + F.floor(F.col("doc_id") / 4)).cast("string"), F.lit(".pdf"))
    return R.with_id_matches(results, documents.select("doc_id", uri("doc_id"), name.alias("filename")), "1000000007", "doc_id")


@query("embeddings")
def sample_hash(embeddings):
    return R.sample(embeddings.select("vec_id", "label"), "vec_id", 100, seed=1)


#: The probes of the queries: the vectors of the five rows whose id has the smallest digest.
PROBES = "SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS query, CAST(embedding AS DOUBLE[]) AS w FROM embeddings QUALIFY query < 5"
PROBED = f"""WITH p AS ({PROBES}), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query, e.vec_id, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))), 6) AS score FROM e, p),
r AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {{k}})
"""


def _probes(embeddings: DataFrame) -> list[list[float]]:
    """Five vectors: five rows come to the driver."""
    rows = embeddings.orderBy(F.md5(F.col("vec_id").cast("string"))).limit(5).select("embedding").collect()
    return [[float(x) for x in r[0]] for r in rows]


@query("embeddings", sql=PROBED.format(k=K) + "SELECT CAST(query AS INTEGER) AS query, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r")
def search_many(embeddings):
    return R.search_many(embeddings, "embedding", _probes(embeddings), K)


@query("embeddings", sql=PROBED.format(k=R.PROBE_RESULTS) + """, u AS (SELECT query, rank, vec_id, score, 'content/' || (vec_id // 2) || '/text' AS uri FROM r),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY uri ORDER BY query, rank) = 1)
SELECT CAST(query AS INTEGER) AS query, CAST(rank AS INTEGER) AS rank, vec_id, uri, score FROM d ORDER BY query, rank LIMIT 300""")
def sample_probes(embeddings):
    """Two vectors each lie under one address, as chunks do."""
    uri = F.concat(F.lit("content/"), F.floor(F.col("vec_id") / 2).cast("string"), F.lit("/text"))
    return R.probed(embeddings.select("vec_id", "embedding", uri.alias("uri")), "embedding", _probes(embeddings), 300)


@query("embeddings", sql=_merged_sql("label = 3", 1.25))
def multislice_deadline(embeddings):
    """Both slices in time give what the search without a deadline gives."""
    found = R.multislice_within(embeddings, "embedding", _vector(embeddings), K, compiled({"label": {"$eq": 3}}, embeddings.schema), seconds=600.0)
    return found.select("vec_id", "label", "slice", "score", "rank")


@query("conversations", "embeddings", "documents", sql="""WITH asked AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
q AS (SELECT * FROM asked ORDER BY request_id LIMIT 60),
before AS (SELECT conv_id, turn, role FROM conversations JOIN (SELECT conv_id, max(turn) AS t FROM q GROUP BY conv_id) USING (conv_id) WHERE turn < t),
h AS (SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS history FROM (SELECT * FROM before WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id),
l AS (SELECT conv_id, max(turn) AS last FROM before GROUP BY conv_id),
good AS (SELECT * FROM q WHERE text <> ''), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY request_id) AS mine FROM good), g AS (SELECT request_id, row_number() OVER (ORDER BY request_id) AS k FROM u WHERE mine <= 6),
v AS (SELECT request_id, CAST(embedding AS DOUBLE[]) AS w FROM good JOIN embeddings ON vec_id = conv_id), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT request_id, vec_id, round(list_dot_product(e.v, w) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(w, w))), 6) AS score FROM e, v),
r AS (SELECT request_id, vec_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5),
c AS (SELECT request_id, string_agg('[Source: ' || coalesce(source, 'unknown') || ']' || chr(10) || coalesce(substr(text, 1, 100), ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM r LEFT JOIN documents ON doc_id = vec_id GROUP BY request_id)
SELECT good.request_id, coalesce(last, 0) + 1 AS turn, coalesce(history, '') AS history, CASE WHEN coalesce(g.k <= 30, false) THEN 'primary' ELSE 'fallback' END AS model, coalesce(n_chunks, 0) AS n_chunks, md5(coalesce(context, '')) AS context_md5
FROM good LEFT JOIN g USING (request_id) LEFT JOIN h USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN c USING (request_id)""")
def chat_answers(conversations, embeddings, documents):
    """The last questions of sixty conversations with their histories, models, contexts and turn numbers; a user asks in every seventh conversation."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = conversations.where("role = 'user'").withColumn("_k", k).where("_k = 1").withColumn("request_id", F.col("conv_id") * 1000 + F.col("turn")).orderBy("request_id").limit(60)
    vectors = embeddings.select(F.col("vec_id").alias("conv_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    name = F.concat(F.lit("c"), "conv_id")
    questions = last.join(vectors, "conv_id", "left").select("request_id", name.alias("conversation_id"), F.concat(F.lit("u"), F.col("conv_id") % 7).alias("user_id"), F.lit("2024-01-01").alias("day"), F.col("text").alias("query"), "embedding")
    before = conversations.join(last.select("conv_id", F.col("turn").alias("_t")), "conv_id").where("turn < _t")
    turns = before.select(name.alias("conversation_id"), "turn", F.lit(-1).cast("long").alias("request_id"), F.col("text").alias("question"), F.col("role").alias("answer"), F.when(F.col("role") == "system", "ERROR").otherwise("COMPLETED").alias("status"))
    chunks = embeddings.select("vec_id", "embedding").join(documents.select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 100).alias("text"), "source"), "vec_id", "left")
    out = chat.answered(questions, turns, chunks, user_limit=6, global_limit=30)
    history = F.array_join(F.transform("history", lambda x: x["turn"].cast("string")), ",")
    return out.where("error is null").select("request_id", "turn", history.alias("history"), "model", "n_chunks", F.md5("context").alias("context_md5"))
