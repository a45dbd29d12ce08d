"""Filtered vector retrieval: exact top-k, two slices with adaptive boost, merging, deduplication, context assembly.

A search is one pass of the vector table per slice: the score is an expression of built-in functions, the filter
and the column pruning reach the scan, and each task keeps its k best rows (TakeOrderedAndProject). What
follows a slice works on at most 2 k rows. Scores are rounded so that an order is the same on every machine.
"""

from __future__ import annotations

import hashlib
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
#: The margin by which filtered results may win, the least and the usual largest boost.
MARGIN, FLOOR, CEILING = 1.05, 1.02, 1.25
#: Results a probe asks for, bounds of the number of probes, seconds a slice may take.
PROBE_RESULTS, FEWEST_PROBES, MOST_PROBES, DEADLINE = 100, 5, 10, 5.0
MAX_QUERY, DEFAULT_RESULTS, FALLBACK_RESULTS, MOST_RESULTS = 10_000, 25, 5, 100


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def cosine(vector: str, query: list[float]) -> Column:
    """Cosine similarity with one query; null for null, zero, shorter and longer vectors. One form for all dimensions: written out, 64 products make code too large to compile."""
    norm = math.sqrt(sum(x * x for x in query))
    double = F.transform(vector, lambda x: x.cast("double"))
    dot = _total(F.zip_with(double, F.array(*[F.lit(float(x)) for x in query]), lambda x, y: x * y))
    size = F.sqrt(_total(F.transform(double, lambda x: x * x)))
    return F.round(dot / F.nullif(size * F.lit(norm), F.lit(0.0)), DIGITS)


def top_k(df: DataFrame, k: int, key: str = "vec_id", score: str = "score") -> DataFrame:
    """The k best rows with a score that is a number; ties to the smaller key."""
    return df.where(F.col(score).isNotNull() & ~F.isnan(score)).orderBy(F.desc(score), key).limit(k)


def boost(best_filtered: Column, best_unfiltered: Column, ceiling: float) -> Column:
    """What filtered scores are multiplied by: enough to pass the best other result, within bounds; the ceiling without competition."""
    raw = best_unfiltered / best_filtered * MARGIN
    bounded = F.least(F.greatest(raw, F.lit(FLOOR)), F.lit(float(ceiling)))
    return F.when(best_filtered.isNull() | best_unfiltered.isNull() | (best_filtered <= 0), F.lit(float(ceiling))).otherwise(bounded)


def slices(df: DataFrame, vector: str, query: list[float], k: int, predicate: Column | None, key: str = "vec_id") -> DataFrame:
    """The k best rows of all and, with a predicate, the k best of those that fulfil it: columns slice, pos, score."""
    scored = df.withColumn("score", cosine(vector, query))
    by = Window.partitionBy("slice").orderBy(F.desc("score"), key)
    out = top_k(scored, k, key).withColumn("slice", F.lit("unfiltered"))
    if predicate is not None:
        out = top_k(scored.where(predicate), k, key).withColumn("slice", F.lit("filtered")).unionByName(out)
    return out.drop(vector).withColumn("pos", F.row_number().over(by))


def merged(found: DataFrame, k: int, ceiling: float = CEILING, key: str = "vec_id") -> DataFrame:
    """slices() in one ranking: filtered scores boosted, each key once at its best, 2 k rows at most. Blank keys are never taken together."""
    everything = Window.partitionBy(F.lit(1))
    best = lambda s: F.max(F.when(F.col("slice") == s, F.col("score"))).over(everything)
    factor = F.when(F.col("slice") == "filtered", boost(best("filtered"), best("unfiltered"), ceiling)).otherwise(1.0)
    out = found.withColumn("score", F.round(F.col("score") * factor, DIGITS))
    order = [F.desc("score"), F.asc("slice"), F.asc("pos")]  # of equal scores the filtered one goes first
    out = first_of(out, key, order)
    rank = F.row_number().over(Window.orderBy(*order))
    return out.withColumn("rank", rank).where(F.col("rank") <= 2 * k).drop("pos")


def multislice(df: DataFrame, vector: str, query: list[float], k: int, predicate: Column | None = None, ceiling: float = CEILING, key: str = "vec_id") -> DataFrame:
    """Two-slice search; without a predicate the plain top-k."""
    if predicate is None:
        return slices(df, vector, query, k, None, key).withColumnRenamed("pos", "rank")
    return merged(slices(df, vector, query, k, predicate, key), k, ceiling, key)


def merged_rows(df: DataFrame, rows: dict[str, list], schema, k: int, ceiling: float, key: str) -> DataFrame:
    """merged() over the collected rows of slices, k each at most."""
    found = [r for name in sorted(rows) for r in rows[name]]
    return merged(df.sparkSession.createDataFrame(found, schema), k, ceiling, key)


def within(df: DataFrame, jobs: dict[str, Callable[[], list]], seconds: float) -> dict[str, list]:
    """What the jobs return that end within so many seconds; the Spark jobs of the others are cancelled, and jobs that fail are left out.

    Each job runs in a thread of its own under a tag, so that cancelling one leaves the others and whatever else the session runs alone.
    """
    context, done, run = df.sparkSession.sparkContext, {}, uuid.uuid4().hex
    end, threads = time.monotonic() + seconds, {}

    def work(name: str) -> None:
        context.addJobTag(f"{run}-{name}")
        try:
            done[name] = jobs[name]()
        except Exception:  # noqa: BLE001, S110 -- a slice that fails or is cancelled is skipped
            pass

    for name in jobs:
        threads[name] = threading.Thread(target=work, args=(name,), daemon=True)
        threads[name].start()
    for name, thread in threads.items():
        thread.join(max(0.0, end - time.monotonic()))
        if thread.is_alive():
            context.cancelJobsWithTag(f"{run}-{name}")
    return dict(done)


def multislice_within(df: DataFrame, vector: str, query: list[float], k: int, predicate: Column | None = None, seconds: float = DEADLINE, ceiling: float = CEILING, key: str = "vec_id") -> DataFrame:
    """multislice() with a deadline: the slices run as jobs side by side, and one that fails or is late is skipped.

    At most k rows a slice come to the driver. Where both slices are there in time, the result is that of multislice(); where one is, the merge of that one alone;
    where none is, no row. Without a predicate there is one slice and no merge.
    """
    scored = df.withColumn("score", cosine(vector, query)).drop(vector)
    plans = {"unfiltered": top_k(scored, k, key)}
    if predicate is not None:
        plans["filtered"] = top_k(df.withColumn("score", cosine(vector, query)).where(predicate).drop(vector), k, key)
    named = {name: plan.withColumn("slice", F.lit(name)).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), key))) for name, plan in plans.items()}
    rows = within(df, {name: plan.collect for name, plan in named.items()}, seconds)
    schema = named["unfiltered"].schema
    if predicate is None:
        return df.sparkSession.createDataFrame(rows.get("unfiltered", []), schema).withColumnRenamed("pos", "rank")
    return merged_rows(df, rows, schema, k, ceiling, key)


def search_many(df: DataFrame, vector: str, queries: list[list[float]], k: int, key: str = "vec_id") -> DataFrame:
    """(query, rank, key, score): the k nearest rows of each query in one pass of the table.

    A task multiplies its vectors with all queries at once and keeps the k best rows of each, so that tasks x queries x k rows of three columns are shuffled,
    whatever the size of the table. Nulls, zero vectors, vectors of another length or with components that are not finite take no part; ties go to the smaller key.
    """
    grid = np.array([[float(x) for x in q] for q in queries], dtype=np.float64).reshape(len(queries), -1)
    width = grid.shape[1]
    grid = grid / np.maximum(np.sqrt((grid**2).sum(1, keepdims=True)), 1e-300)
    kind = df.schema[key].dataType.simpleString()

    def best(keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, -scores))
        return order[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(grid)
        for b in batches:
            rows, keys = b.column(1), b.column(0)
            fits = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(rows), width), keys.is_valid()), False)
            rows, keys = rows.filter(fits), keys.filter(fits).to_numpy(zero_copy_only=False)
            if not len(rows):
                continue
            x = pc.cast(rows.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x, keys = x[good], keys[good]
            scores = np.round((x @ grid.T) / np.sqrt((x**2).sum(1, keepdims=True)), DIGITS)
            for q in range(len(grid)):
                every, every_score = np.concatenate([held[q][0], keys]), np.concatenate([held[q][1], scores[:, q]])
                top = best(every, every_score)
                held[q] = every[top], every_score[top]
        n = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(grid)), n), pa.int32()), pa.array(np.concatenate([h[0] for h in held]), pa.int64()), pa.array(np.concatenate([h[1] for h in held]), pa.float64())], names=["query", key, "score"])

    found = df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"query int, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", F.col(key).cast(kind).alias(key), "score")


def probe_count(most: int) -> int:
    """Probes for a sample of so many rows: one for each hundred, within bounds."""
    return min(MOST_PROBES, max(FEWEST_PROBES, most // 100))


def probes(most: int, width: int, seed: str = "probe") -> list[list[float]]:
    """Random directions, the same for one seed: nothing in a corpus is near them, so what they find is spread over it."""
    number = lambda i: np.frombuffer(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], np.uint64)[0]
    return [np.random.Generator(np.random.PCG64(int(number(i)))).standard_normal(width).tolist() for i in range(probe_count(most))]


def probed(df: DataFrame, vector: str, queries: list[list[float]], most: int, key: str = "vec_id", uri: str = "uri", results: int = PROBE_RESULTS) -> DataFrame:
    """A sample of `most` rows (query, rank, key, uri, score) through probes: the union of their results, each uri once at its first place, blank ones never.

    The order is that of the probes and of the ranks within them. df holds key, vector and uri.
    """
    found = search_many(df, vector, queries, results, key)
    with_uri = found.join(df.select(key, uri), key).where(F.coalesce(F.trim(uri), F.lit("")) != "")
    one = with_uri.groupBy(uri).agg(F.min(F.struct("query", "rank", key, "score")).alias("m")).select("m.query", "m.rank", f"m.{key}", uri, "m.score")
    return one.orderBy("query", "rank").limit(most)


def first_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows whose key is null or blank stay."""
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    n = F.row_number().over(Window.partitionBy(F.when(~blank, F.col(key))).orderBy(*order))
    return df.withColumn("_n", F.when(blank, 1).otherwise(n)).where("_n = 1").drop("_n")


def best_per_key(df: DataFrame, key: str, score: str = "score", pos: str = "pos") -> DataFrame:
    """The best row of each key, the earlier one of equal scores, in order of score."""
    return first_of(df, key, [F.desc(score), F.asc(pos)]).orderBy(F.desc(score), pos)


def enriched(results: DataFrame, catalogue: DataFrame, on: str) -> DataFrame:
    """Results with their catalogue row, if any; the type `scrape` reads scraped, a missing one document."""
    both = results.join(catalogue, on, "left")
    if "type" not in both.columns:
        return both
    return both.withColumn("type", F.when(F.col("type") == "scrape", "scraped").otherwise(F.coalesce("type", F.lit("document"))))


def parsed(results: DataFrame, uri: str = "uri") -> DataFrame:
    """Result uris taken apart: is_segment, is_media, document_id, timestamp_start and the key by which results are deduplicated."""
    c = F.col(uri)
    segment = F.contains(c, F.lit("/segment-"))
    document = F.nullif(F.regexp_extract(c, "content/([a-f0-9-]{36})/", 1), F.lit(""))
    out = results.withColumn("is_segment", segment).withColumn("document_id", document)
    out = out.withColumn("is_media", segment | F.coalesce(F.col("content_type").isin("video", "audio", "media", "transcript"), F.lit(False)) if "content_type" in results.columns else segment)
    if "timestamp_start" in results.columns:
        seconds = F.col("timestamp_start").cast("string").try_cast("long")
        millis = F.floor(F.col("timestamp_millis").try_cast("double") / 1000) if "timestamp_millis" in results.columns else F.lit(None)
        out = out.withColumn("timestamp_start", F.coalesce(seconds, millis.cast("long")))
    return out.withColumn("dedup_key", F.when(segment, c).otherwise(document))


def response(results: DataFrame, documents: DataFrame, allow: bool = True) -> DataFrame:
    """What a search returns: one row per result in the order of rank, with the seventeen fields of the answer.

    results (rank, uri, content, score, content_type and what parsed() reads), documents (document_id, filename, type, source_url, media_type, input_uri). Addresses of
    documents are given only where access to them is allowed; fields that a kind of document has not are null.
    """
    rows = parsed(results).join(documents, "document_id", "left")
    scraped, image = (F.coalesce(F.col("type").isin(*kinds), F.lit(False)) for kinds in (("scraped", "scrape"), ("image",)))
    media = F.col("is_media") | F.coalesce(F.col("type") == "media", F.lit(False))
    url = F.when(F.lit(allow), F.when(scraped, F.col("source_url")).otherwise(F.coalesce("input_uri", "uri")))
    segment = F.when(F.lit(allow) & F.col("is_segment") & F.col("timestamp_start").isNotNull(), F.concat(url, F.lit("#t="), F.col("timestamp_start").cast("string")))
    fields = {
        "content": F.col("content"), "source": F.coalesce(F.when(scraped, F.col("uri")), F.col("input_uri"), F.col("uri")), "score": F.coalesce("score", F.lit(0.0)), "document_id": F.col("document_id"), "filename": F.col("filename"),
        "document_url": url, "document_access_allowed": F.lit(allow), "is_scraped": scraped, "source_url": F.when(scraped, F.col("source_url")), "is_image": image, "thumbnail_url": F.when(image, url),
        "is_media": media, "media_type": F.when(media, F.col("media_type")), "is_segment": F.col("is_segment"), "segment_url": segment, "timestamp_start": F.when(media, F.col("timestamp_start")), "is_visual_match": F.coalesce(F.col("content_type") == "visual", F.lit(False)),
    }
    return rows.select("rank", *(c.alias(n) for n, c in fields.items())).orderBy("rank")


def context(results: DataFrame, text: str, source: str, rank: str = "rank", chunks: int = 5, group: str | None = None) -> DataFrame:
    """One row (per group) with the first chunks under headers that name their source, for a prompt."""
    block = F.concat(F.lit("[Source: "), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    rows = results.where(F.col(rank) <= chunks).select(*([group] if group else []), F.col(rank).alias("_rank"), block.alias("_block"))
    joined = F.expr("listagg(_block, '\\n\\n---\\n\\n') within group (order by _rank)").alias("context")
    count = F.count("*").alias("n_chunks")
    return rows.groupBy(group).agg(joined, count) if group else rows.agg(joined, count)


def with_id_matches(results: DataFrame, catalogue: DataFrame, number: str | None, key: str, uri: str = "uri", filename: str = "filename", most: int = 3) -> DataFrame:
    """Results behind the (three) files whose name holds the number that the query names, unless a result's uri holds it already."""
    if not number:
        return results.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    rows = results.withColumn("_front", F.lit(False))
    known = results.where(F.contains(F.col(uri), F.lit(number))).select(F.lit(number).alias("_id")).limit(1)
    named = catalogue.where(F.contains(F.col(filename), F.lit(number))).orderBy(key).limit(most)
    found = named.withColumn("_id", F.lit(number)).join(known, "_id", "left_anti")
    # each match is put before the ones found earlier
    number_ = F.row_number().over(Window.orderBy(F.desc(key)))
    found = found.select(F.col(key), F.col(uri), F.lit(1.0).alias("score"), number_.alias("rank"), F.lit(True).alias("_front"))
    both = found.unionByName(rows.select(key, uri, "score", "rank", "_front"))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_front"), "rank"))).drop("_front")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, uniform and the same in every run: the smallest by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def results_wanted(value: object) -> int:
    """How many results a search returns: 25 if nothing is said, 5 if it makes no sense."""
    if value is None:
        return DEFAULT_RESULTS
    try:
        n = int(value)
    except (TypeError, ValueError):
        return FALLBACK_RESULTS
    return n if 1 <= n <= MOST_RESULTS else FALLBACK_RESULTS


def query_error(query: object) -> str | None:
    """Why a query text is refused, or None."""
    if not isinstance(query, str):
        return "the query must be a string"
    if not query.strip():
        return "the query is empty"
    return "the query is too long" if len(query) > MAX_QUERY else None
