"""Time windows of transcripts and pages of scanned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GROUP = 30, 300


def timed(items: DataFrame, labels: DataFrame | None = None, start: str = "start_time") -> DataFrame:
    """Words with the speaker whose label has the same start, as text; of several labels the last."""
    if labels is None:
        return items.withColumn("speaker", F.lit(None).cast("string"))
    one = labels.groupBy(start).agg(F.max_by("speaker", "pos").alias("speaker"))
    return items.join(one, start, "left")


def segments(words: DataFrame, media: str, start: str, word: str, order: list[str], speaker: str | None = None, durations: DataFrame | None = None, size: int = WINDOW) -> DataFrame:
    """(media, segment_index, timestamp_start, timestamp_end, text, word_count, speaker) for each window, empty ones too.

    words hold spoken words only (no punctuation); those without a start are dropped. durations: (media, duration); without it the
    last start decides. Words behind the last window belong to it.
    """
    rows = words.where(F.col(start).isNotNull())
    if durations is None:
        durations = rows.groupBy(media).agg((F.max(start) + F.lit(1)).alias("duration"))
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / size)).cast("long")
    counts = durations.select(media, n.alias("_n"))
    at = rows.join(counts, media).withColumn("segment_index", F.least(F.floor(F.col(start) / size), F.col("_n") - 1).cast("long"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(word).alias("_w")))), lambda x: x["_w"]), " ")
    made = at.groupBy(media, "segment_index").agg(text.alias("text"), F.count("*").alias("word_count"))
    if speaker:
        made = made.join(primary_speaker(at, [media, "segment_index"], speaker, order), [media, "segment_index"], "left")
    every = counts.select(media, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("segment_index"))
    out = every.join(made, [media, "segment_index"], "left")
    out = out.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("word_count", F.coalesce("word_count", F.lit(0)).cast("long"))
    return out.withColumn("timestamp_start", F.col("segment_index") * size).withColumn("timestamp_end", (F.col("segment_index") + 1) * size)


def primary_speaker(words: DataFrame, keys: list[str], speaker: str, order: list[str]) -> DataFrame:
    """The speaker with most words, of several the one who spoke first."""
    each = words.where(F.col(speaker).isNotNull()).groupBy(*keys, speaker).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    # the least of (fewer words, later first word)
    return each.groupBy(*keys).agg(F.min_by(F.col(speaker), F.struct(-F.col("_n"), F.col("_first"))).alias("speaker"))


def groups(rows: DataFrame, keys: list[str], at: Column, size: int = GROUP) -> DataFrame:
    """Rows by windows of `size` seconds: count and ends."""
    return rows.withColumn("window_index", F.floor(at / size)).groupBy(*keys, "window_index").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def pages(lines: DataFrame, document: str, page: str, line: list[str], text: str, confidence: str) -> DataFrame:
    """(document, page, text, confidence) for all pages from the first to the last one: lines joined, the mean confidence, blank pages too."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*line, F.col(text).alias("_t")))), lambda x: x["_t"]), "\n")
    made = lines.groupBy(document, page).agg(joined.alias("text"), F.avg(confidence).alias("confidence"))
    bounds = lines.groupBy(document).agg(F.min(page).alias("_a"), F.max(page).alias("_z"))
    every = bounds.select(document, F.explode(F.sequence("_a", "_z")).alias(page))
    return every.join(made, [document, page], "left").withColumns({"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})


def combined(parts: DataFrame, document: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of a document's parts behind one another."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("_t")))), lambda x: x["_t"])
    return parts.groupBy(document).agg(F.array_join(rows, separator).alias("text"), F.count("*").alias("n_parts"))


def text_native(pages_: DataFrame, document: str, page: str, text: str, least: int = 50, first: int = 3) -> DataFrame:
    """Whether the first pages hold text enough to need no recognition."""
    return pages_.where(F.col(page) <= first).groupBy(document).agg((F.avg(F.length(F.trim(text))) >= least).alias("is_text_native"))


def summary(segments_: DataFrame, media: str) -> DataFrame:
    return segments_.groupBy(media).agg(F.count("*").alias("n_segments"), F.max("timestamp_end").alias("duration"), F.countDistinct("speaker").alias("n_speakers"))


def duration_estimate(size: Column, video: Column) -> Column:
    """Seconds by size where nothing better is known."""
    return F.greatest(F.lit(30.0), size / F.when(video, 1e6).otherwise(128e3))
