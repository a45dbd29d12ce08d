"""Flows over tables: views of catalogue rows, visual context, seeds of crawls, page processing, retries with less metadata, rebuilds and their tallies.

Each is a join, an aggregate or a projection over whole tables; what a service does for one item at a time is done for all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..functions import urls as U

#: Statuses with a preview, statuses in which a document cannot be processed again, features that a demonstration lacks,
#: statuses of an indexed document, and the closing lines of an image's text.
PREVIEWED = ["OCR_COMPLETE", "EMBEDDING_COMPLETE", "INDEXED"]
BUSY = ["processing", "transcribing", "pending"]
DISABLED = ["reindex_all", "reprocess", "delete_documents"]
DONE = ["INDEXED", "STARTING", "IN_PROGRESS"]
IMAGE_WORDS = ["---", "Content type: image, picture, photo, photograph, visual, media, graphic, imagery", "This is a visual image file that can be viewed and displayed.", ""]
MAX_ERROR, MAX_MESSAGES, MAX_BLOCK_ERROR = 500, 5, 100


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """Fields in their order between lines of three dashes, before the body; null ones are left out."""
    lines = F.array_compact(F.array(*(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def scraped(body: Column, source_url: Column, title: Column, scraped_at: Column) -> Column:
    """A page's Markdown with its source, its title in quotation marks (none if blank) and its time."""
    quoted = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit('"'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')))
    return front_matter({"source_url": source_url, "title": quoted, "scraped_at": scraped_at}, body)


def scraped_name(title: Column, url: Column, document: Column) -> Column:
    """What a scraped page is called: its title, else its address, else its id."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(url, F.lit("")), document.cast("string"))


def page_blocks(pages: DataFrame, document: str, number: str, text: str) -> DataFrame:
    """(document, text): the pages of each document in order, each under a line with its number."""
    block = F.concat(F.lit("--- Page "), F.col(number).cast("string"), F.lit(" ---\n"), F.coalesce(F.col(text), F.lit("")))
    each = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b"))))
    return pages.groupBy(document).agg(F.array_join(F.transform(each, lambda x: x["b"]), "\n\n").alias("text"))


def image_text(image: Column, filename: Column, user: Column, made: Column) -> Column:
    """The text under which an image is found: front matter, captions and words for pictures."""
    some = lambda c: F.nullif(c, F.lit(""))
    caption = some(M.caption(user, made))
    line = lambda name, c: F.concat(F.lit(name), c)
    head = [F.lit("---"), line("image_id: ", image.cast("string")), line("filename: ", filename), F.lit("type: image"), F.lit("source_type: uploaded_image"), line("user_caption: ", some(user)), line("ai_caption: ", some(made)), F.lit("---"), F.lit("")]
    titled = F.when(caption.isNotNull(), F.concat(F.lit("# Image: "), filename, F.lit("\n\n"), caption, F.lit("\n")))
    own = [F.when(some(c).isNotNull() & (c != F.coalesce(caption, F.lit(""))), F.concat(F.lit(name), c, F.lit("\n"))) for name, c in (("User description: ", user), ("AI description: ", made))]
    return F.array_join(F.array_compact(F.array(*head, titled, *own, *map(F.lit, IMAGE_WORDS))), "\n")


def view(df: DataFrame) -> DataFrame:
    """Catalogue rows as they are shown: upper-case status, defaults, a preview for finished ones only."""
    status = F.upper(F.coalesce("status", F.lit("uploaded")))
    preview = F.when(status.isin(PREVIEWED), F.col("output_uri"))
    return df.select("document_id", F.coalesce("filename", F.lit("")).alias("filename"), status.alias("status"), F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.coalesce("created_at", "updated_at").alias("shown_at"), preview.alias("preview"))


def native_page(df: DataFrame, key: str, after: int | None, limit: int, predicate: Column) -> DataFrame:
    """The rows that fulfil the predicate among the next `limit` ones by key: the limit comes first, so a page may be short."""
    rest = df if after is None else df.where(F.col(key) > after)
    return rest.orderBy(key).limit(limit).where(predicate)


def common_keys(objects: Column) -> Column:
    """array<map>: the keys that all objects of a list have, in order."""
    keys = F.transform(objects, lambda m: F.map_keys(m))
    first = F.get(keys, F.lit(0))
    return F.array_sort(F.aggregate(keys, first, lambda s, k: F.array_intersect(s, k)))


def allowed(feature: Column, demo: Column) -> Column:
    """Whether a feature may be used; a demonstration lacks some."""
    return ~(F.coalesce(demo, F.lit(False)) & feature.isin(DISABLED))


def summary(operation: Column, success: Column, duration: Column, items: Column, error: Column) -> Column:
    """A line for the log: milliseconds in two places, errors cut, absent fields left out."""
    return F.to_json(F.struct(operation.alias("operation"), success.alias("success"), F.round(duration, 2).alias("duration_ms"), items.alias("item_count"), F.nullif(F.substring(error, 1, MAX_ERROR), F.lit("")).alias("error")))


def metered(calls: DataFrame) -> DataFrame:
    """Tokens by context and model."""
    return calls.groupBy("context", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def slice_telemetry(found: DataFrame, asked: int) -> DataFrame:
    """How full the filtered slice is, and its best score over the best of all (0 without either); found is what retrieval.slices gives."""
    n = F.count_if(F.col("slice") == "filtered")
    best = lambda s: F.max(F.when(F.col("slice") == s, F.col("score")))
    ratio = F.when(best("unfiltered") > 0, best("filtered") / best("unfiltered"))
    return found.agg(F.round(n / F.lit(max(asked, 1)), 4).alias("fill_rate"), F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("score_ratio"), n.alias("filtered_count"), F.count_if(F.col("slice") == "unfiltered").alias("unfiltered_count"))


def with_visual_context(results: DataFrame, images: DataFrame, segments: DataFrame) -> DataFrame:
    """Results (rank, document_id, content_type, kind, segment, content) with the text that visual matches stand for: an image's caption, a segment's
    text, or a medium's first segment. Two joins by key; other results keep their content."""
    at = F.when((F.col("content_type") == "visual") & (F.col("kind") == "media"), F.coalesce("segment", F.lit(0)))
    rows = results.withColumn("_at", at)
    rows = rows.join(images.select(F.col("document_id").alias("_i"), F.col("caption").alias("_caption")), (F.col("_i") == F.col("document_id")) & (F.col("kind") == "image") & (F.col("content_type") == "visual"), "left")
    rows = rows.join(segments.select(F.col("document_id").alias("_d"), F.col("segment").alias("_s"), F.col("text").alias("_text")), (F.col("_d") == F.col("document_id")) & (F.col("_s") == F.col("_at")), "left")
    context = F.nullif(F.coalesce("_caption", "_text"), F.lit(""))
    wrapped = F.when(F.coalesce("content", F.lit("")) == "", context).otherwise(F.concat(context, F.lit("\n\n[Visual match from: "), F.col("content"), F.lit("]")))
    return rows.withColumn("content", F.coalesce(wrapped, F.col("content"))).drop("_at", "_i", "_caption", "_d", "_s", "_text")


def with_seed(pages: DataFrame, jobs: DataFrame, carried: list[str]) -> DataFrame:
    """pages (document_id, job_id, source_url, ...) with the columns `carried` of the first page whose address is its job's base_url, as seed_*."""
    seeds = pages.join(jobs.select("job_id", F.col("base_url").alias("source_url")).distinct(), ["job_id", "source_url"], "left_semi")
    first = seeds.groupBy("job_id").agg(F.min_by(F.struct("document_id", *carried), "document_id").alias("_seed"))
    out = pages.join(first, "job_id", "left")
    return out.select(*pages.columns, F.col("_seed.document_id").alias("seed_id"), *(F.col("_seed")[c].alias(f"seed_{c}") for c in carried)).drop("_seed")


def page_changes(pages: DataFrame, known: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages (job_id, url, markdown, error) against the latest hashes (url_hash, content_hash): each page's status and hash, and counts by job.

    Failed pages are FAILED; pages with a known content of their address are SKIPPED, which counts as processed; the others are COMPLETED and get a key.
    """
    rows = pages.withColumn("url_hash", U.url_hash(F.col("url"))).withColumn("content_hash", U.content_hash(F.col("markdown")))
    # an address may be known with several contents: a page meets one row at most, so that none is counted twice
    rows = rows.join(known.select("url_hash", "content_hash").distinct().withColumn("_known", F.lit(True)), ["url_hash", "content_hash"], "left")
    failed = F.col("error").isNotNull() | F.col("markdown").isNull()
    same = F.lit(not force) & F.coalesce("_known", F.lit(False))
    status = F.when(failed, "FAILED").when(same, "SKIPPED").otherwise("COMPLETED")
    slug = U.slug(F.col("url"))
    out = rows.withColumn("status", status).withColumn("key", F.when(F.col("status") == "COMPLETED", F.concat(F.lit("content/"), F.col("job_id").cast("string"), F.lit("/"), slug, F.lit(".md")))).drop("_known", "markdown", "error")
    counts = out.groupBy("job_id").agg(F.count_if(F.col("status") != "FAILED").alias("processed_count"), F.count_if(F.col("status") == "FAILED").alias("failed_count"), F.count_if(F.col("status") == "SKIPPED").alias("skipped_count"))
    return out, counts


def ingested(rows: DataFrame, metadata: str, tried, levels: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """rows with status, level and the metadata that was accepted: tried(metadata column) gives a status, and what fails is tried again with
    metadata reduced to the next level. All levels are columns of one pass, the first that does not fail is taken, else the last."""
    attempts = F.array(*(F.struct(F.lit(n).alias("level"), tried(M.reduce(F.col(metadata), n)).alias("status"), M.reduce(F.col(metadata), n).alias("metadata")) for n in levels))
    good = F.filter(attempts, lambda a: a["status"] != "FAILED")
    taken = F.coalesce(F.get(good, F.lit(0)), F.get(attempts, F.lit(len(levels) - 1)))
    return rows.withColumn("_a", taken).drop(metadata).select("*", F.col("_a.level").alias("level"), F.col("_a.status").alias("status"), F.col("_a.metadata").alias(metadata)).drop("_a")


def rebuilt(content: DataFrame, texts: DataFrame, batch: int = 10) -> tuple[DataFrame, DataFrame]:
    """A rebuild of the index from content (document_id, filename, type) and texts (document_id, text): the new chunks, and a row for each batch.

    Every item counts as processed; those without text or with a type that is not indexed are errors with a message.
    """
    rows = content.join(texts, "document_id", "left")
    error = F.when(F.col("text").isNull(), "no text").when(~F.coalesce("type", F.lit("document")).isin("document", "scraped", "image", "media"), "unknown type")
    rows = rows.withColumn("error", F.when(error.isNotNull(), F.concat(F.coalesce("filename", F.lit("")), F.lit(": "), F.substring(error, 1, MAX_BLOCK_ERROR))))
    chunks = rows.where("error is null").select("document_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))
    return chunks, tallies(rows.withColumn("batch", F.floor(F.col("document_id") / batch)), "batch")


def tallies(rows: DataFrame, by: str) -> DataFrame:
    """(by, processed_count, error_count, last_errors) of rows with document_id and error: the five last messages by id. Tasks keep five of each group."""
    counts = rows.groupBy(by).agg(F.count("*").alias("processed_count"), F.count("error").alias("error_count"))
    newest = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("document_id"), F.desc("error")))
    last = rows.where("error is not null").select(by, "document_id", "error").withColumn("_k", newest).where(F.col("_k") <= MAX_MESSAGES)
    said = last.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("_k", "error"))).alias("_last"))
    text = F.coalesce(F.array_join(F.transform("_last", lambda x: x["error"]), " | "), F.lit(""))
    return counts.join(said, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "processed_count", "error_count", text.alias("last_errors"))


def may_reprocess(status: Column, kind: Column, reindex: bool = False) -> Column:
    """Why a document cannot be processed again, or null if it can: it is busy, or a scraped page (which can only be indexed again)."""
    return F.when(F.lower(status).isin(BUSY), "busy").when(F.lit(not reindex) & (kind == "scraped"), "scraped")


def indexed_uris(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """The addresses under which each document is indexed, for its removal; visual ones are told apart, for a new index of the text keeps them."""
    return chunks.select(document, "uri", (F.col("content_type") == "visual").alias("visual")).distinct()
