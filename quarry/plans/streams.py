"""Queries that run a stream over all that is there (availableNow) and return what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rebuild
from ..session import scratch, table
from ..streaming import jobs, state
from ..streaming.queue import Queue, object_events
from .registry import ORACLE_SQL, QUERIES


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # as a pattern, the path may be a folder or one file
    return jobs.files(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)


def _complete(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The last state of a stream in complete mode: every batch writes all of it anew."""
    folder = scratch(spark, name)
    jobs.drained(df, folder + "-checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(folder), "complete")
    return spark.read.schema(df.schema).parquet(folder)


def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by five minutes and type."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be an instant
    counts = _complete(spark, jobs.counted(events, "ts", ["event_type"], "5 minutes"), "tumbling")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type that a stream meets, as keys."""
    folder = scratch(spark, "visited")
    keys = jobs.unseen(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])
    jobs.drained(keys, folder + "-checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
    return spark.read.parquet(folder).select("user_id", "event_type")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and times per event type, merged batch by batch into a table of versions."""
    folder = scratch(spark, "upsert")
    sink = jobs.Table(spark, folder, "event_type string, n bigint, first_seen timestamp_ntz, last_seen timestamp_ntz", ["event_type"], keep=("first_seen",), add=("n",))
    last = []

    def each(batch: DataFrame, number: int) -> None:
        sink.merge(batch.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")), number)
        last[:] = [number]

    jobs.drained(_events(spark, sf_dir).select("event_type", "ts"), folder + "-checkpoint", each)
    return sink.version(last[0] + 1 if last else 0)


def _appended(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """All that a stream in append mode has put out."""
    folder = scratch(spark, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    jobs.drained(df, folder + "-checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/batch={n}"))
    return spark.read.schema(df.schema).parquet(f"{folder}/batch=*")


def stream_expired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user and type, forgotten two days after the last one: what was known of them then."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    calls = events.select(F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), "ts")
    return _appended(spark, state.expiring(calls, 3, 2 * state.DAY), "expired")


#: The events as requests to jobs and as pages of them.
KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'found' WHEN 'click' THEN 'done' WHEN 'error' THEN CASE WHEN value > 90 THEN 'failed' ELSE 'skipped' END ELSE CASE WHEN value < 20 THEN 'cancel' ELSE 'drained' END END"


def stream_job_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each job's status, from a stream of requests and one of pages."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.expr(KIND).alias("kind"))
    asked = F.col("kind").isin("start", "cancel", "drained")
    return _appended(spark, state.lives(rows.where(asked), rows.where(~asked)), "lives")


def queue_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that fail as often as their text's length says, up to three times: how each of them ends."""
    queue = Queue(spark, scratch(spark, "queue"), size=500, batches=16)
    body = F.coalesce(F.length("text"), F.lit(0)).cast("string")
    queue.send(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("message_id"), body.alias("body")), "documents")
    queue.consume(lambda batch: batch.select("message_id", F.when(F.col("receives") < F.col("body").cast("int") % 5, "busy").alias("error")))
    ends = [rows.select(F.col("message_id").cast("long").alias("doc_id"), "receives", F.lit(end).alias("ended")) for rows, end in ((queue.done(), "done"), (queue.dead(), "dead"))]
    return ends[0].unionByName(ends[1])


def media_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of created objects, by the documents' ids, sources and languages: those of media below content/ are taken up."""
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ["mp4", "MP3", "txt", "wav", "webm", "ogg", ""])), (F.length(F.coalesce("text", F.lit(""))) % 7 + 1).cast("int"))
    key = F.concat(F.when(F.col("lang") == "de", "other/").otherwise("content/"), "doc_id", F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("."), ending)
    return object_events(docs.select(F.to_json(F.struct(F.struct(F.lit("box").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object"))).alias("detail")))


def stream_media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they arrive, in windows of thirty seconds with their speaker, as rows of the index."""
    words = _events(spark, sf_dir).select(F.col("user_id").alias("media"), F.col("event_id").alias("id"), (F.col("event_id") % 1000).alias("start"), F.col("event_type").alias("word"), F.when(F.col("value") > 30, F.col("event_type")).alias("speaker"))
    out = jobs.Transcripts(spark, scratch(spark, "media"))
    out.take(words)
    return out.segments()


class Broken(Exception):
    """What a run of the query is broken off by."""


def rebuild_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tallies of a rebuild that was broken off after two waves and taken up again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "rebuild")
    content = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.when(F.col("lang") == "es", "other").otherwise("document").alias("type"))
    texts = docs.where("n_chars > 200").select(F.col("doc_id").alias("document_id"), "text")

    def stop(wave: int) -> None:
        if wave == 1:
            raise Broken

    try:
        rebuild.run(folder, "first", content, texts, waves=4, after=stop)
    except Broken:
        pass
    return rebuild.run(folder, "first", content, texts).select("batch", "processed_count", "error_count", "last_errors")


QUERIES |= {f.__name__: f for f in (stream_tumbling_counts, stream_visited, stream_upsert, stream_expired_calls, stream_job_lives, queue_retries, media_arrivals, stream_media_segments, rebuild_resumed)}
ORACLE_SQL |= {
    "stream_tumbling_counts": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_visited": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_upsert": "SELECT event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1",
    "stream_expired_calls": """WITH c AS (SELECT user_id || '/' || event_type AS key, epoch_us(ts) // 1000 AS m, event_id FROM events),
g AS (SELECT *, coalesce(m - lag(m) OVER (PARTITION BY key ORDER BY m, event_id) >= 172800000, true) AS new FROM c),
s AS (SELECT *, count_if(new) OVER (PARTITION BY key ORDER BY m, event_id ROWS UNBOUNDED PRECEDING) AS part FROM g),
t AS (SELECT key, part, min(m) AS first_ms, count(*) AS n, least(count(*), 3) AS admitted, max(m) + 172800000 AS expired_ms FROM s GROUP BY key, part)
SELECT key, first_ms, n, admitted, expired_ms FROM t WHERE expired_ms <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) OR EXISTS (SELECT 1 FROM t l WHERE l.key = t.key AND l.part > t.part)""",
    "stream_job_lives": f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, event_id AS id, {KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS was, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS processed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS at_ms, CAST(0 AS BIGINT) AS id FROM events
  UNION ALL SELECT s.user_id, e.k, CASE WHEN kind = 'start' AND NOT open THEN 'PENDING' WHEN NOT open THEN status WHEN kind = 'cancel' THEN 'CANCELLED' WHEN kind = 'found' AND status = 'PENDING' THEN 'DISCOVERING'
      WHEN kind IN ('done', 'skipped', 'failed') THEN 'PROCESSING' WHEN kind = 'drained' AND total > 0 AND processed + failed >= total THEN CASE WHEN failed / total > 0.1 THEN 'FAILED' WHEN failed > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END ELSE status END,
    status, CASE WHEN kind = 'start' AND NOT open THEN 0 WHEN open AND kind = 'found' THEN total + 1 ELSE total END,
    CASE WHEN kind = 'start' AND NOT open THEN 0 WHEN open AND kind IN ('done', 'skipped') THEN processed + 1 ELSE processed END,
    CASE WHEN kind = 'start' AND NOT open THEN 0 WHEN open AND kind = 'failed' THEN failed + 1 ELSE failed END,
    refused + CASE WHEN (kind = 'start' AND open) OR (kind = 'cancel' AND NOT open) THEN 1 ELSE 0 END, e.at_ms, e.id
  FROM (SELECT *, coalesce(status IN ('PENDING', 'DISCOVERING', 'PROCESSING'), false) AS open FROM s) s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT CAST(user_id AS VARCHAR) AS job_id, at_ms, id, status, total, processed, failed, refused FROM s WHERE status IS DISTINCT FROM was""",
    "queue_retries": "SELECT doc_id, CAST(least(coalesce(length(text), 0) % 5 + 1, 3) AS INTEGER) AS receives, CASE WHEN coalesce(length(text), 0) % 5 < 3 THEN 'done' ELSE 'dead' END AS ended FROM documents",
    "media_arrivals": """WITH d AS (SELECT doc_id, lang, coalesce(source, 'none') || '.' || (['mp4', 'MP3', 'txt', 'wav', 'webm', 'ogg', ''])[length(coalesce(text, '')) % 7 + 1] AS filename, length(coalesce(text, '')) % 7 AS e FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, filename, 's3://box/content/' || doc_id || '/' || filename AS input_uri, 's3://box/content/' || doc_id || '/' AS output_prefix, CASE WHEN e IN (0, 4) THEN 'video' ELSE 'audio' END AS media_type
FROM d WHERE lang IS DISTINCT FROM 'de' AND e NOT IN (2, 6)""",
    "stream_media_segments": """WITH w AS (SELECT user_id, event_id, event_type, event_id % 1000 AS s, CASE WHEN value > 30 THEN event_type END AS speaker FROM events), n AS (SELECT user_id, CAST(ceil((max(s) + 1) / 30.0) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT user_id, s // 30 AS i, string_agg(event_type, ' ' ORDER BY s, event_id) AS text, count(*) AS c FROM w GROUP BY ALL),
k AS (SELECT user_id, s // 30 AS i, speaker, count(*) AS c, min(s * 100000000 + event_id) AS f FROM w WHERE speaker IS NOT NULL GROUP BY ALL), p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY c DESC, f) = 1),
e AS (SELECT user_id, unnest(range(0, n)) AS i FROM n)
SELECT e.user_id AS media, e.i AS segment_index, e.i * 30 AS timestamp_start, e.i * 30 + 30 AS timestamp_end, coalesce(text, '') AS text, coalesce(g.c, 0) AS word_count, speaker, 'content/' || e.user_id || '/segment-' || lpad(CAST(e.i AS VARCHAR), 3, '0') || '.txt' AS uri
FROM e LEFT JOIN g ON e.user_id = g.user_id AND e.i = g.i LEFT JOIN p ON e.user_id = p.user_id AND e.i = p.i""",
    "rebuild_resumed": """WITH r AS (SELECT doc_id, doc_id // 10 AS batch, coalesce(source, '') || ': ' || CASE WHEN n_chars > 200 AND text IS NOT NULL THEN CASE WHEN lang = 'es' THEN 'unknown type' END ELSE 'no text' END AS error FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id DESC, error DESC) AS k FROM r WHERE error IS NOT NULL)
SELECT r.batch, count(*) AS processed_count, count(error) AS error_count, coalesce((SELECT string_agg(k.error, ' | ' ORDER BY k.k) FROM k WHERE k.batch = r.batch AND k.k <= 5), '') AS last_errors FROM r GROUP BY r.batch""",
}
