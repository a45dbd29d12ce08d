"""The key catalogue: which metadata keys occur, how often, of what type, with which values."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .catalog import upsert
from .filters import names_only

SAMPLES, SAMPLE_CHARS = 10, 100
#: Keys that media segments carry, with their types.
MEDIA_KEYS = {"content_type": "string", "media_type": "string", "timestamp_start": "number", "timestamp_end": "number", "speaker": "string", "segment_index": "number", "duration_seconds": "number"}
MEDIA_SAMPLES = {"content_type": ["transcript", "visual"], "media_type": ["video", "audio"]}
#: Key prefixes of the store itself.
SYSTEM = ("x-amz-", "AMAZON_BEDROCK")
LIBRARY = "key_name string, data_type string, sample_values array<string>, occurrence_count bigint, first_seen timestamp, last_seen timestamp, status string"


def value_kind(value: Column) -> Column:
    """boolean, number or string of a value in text form, list if it looks like a JSON array."""
    return F.when(value.isin("true", "false"), "boolean").when(value.try_cast("double").isNotNull(), "number").when(value.rlike("^\\[.*\\]$"), "list").otherwise("string")


def profile(maps: DataFrame, metadata: str, order: str) -> DataFrame:
    """(key_name, n, rate, data_type, sample_values) of all maps: type of the first value by `order`, the first ten distinct values.

    Values are counted per key and value first, so that a key with very many values leaves each task in small pieces and
    only its ten earliest values meet.
    """
    total = maps.agg(F.count("*").alias("total"))
    entries = maps.select(F.col(order).alias("_o"), F.explode(metadata).alias("key_name", "_v")).where("_v is not null")
    for p in SYSTEM:
        entries = entries.where(~F.startswith("key_name", F.lit(p)))
    values = entries.withColumn("_v", F.substring("_v", 1, SAMPLE_CHARS)).groupBy("key_name", "_v").agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    k = F.row_number().over(Window.partitionBy("key_name").orderBy("_o", "_v"))
    first = values.withColumn("_k", k).where(F.col("_k") <= SAMPLES)
    samples = first.groupBy("key_name").agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_s"))
    counts = values.groupBy("key_name").agg(F.sum("_n").alias("n"))
    out = counts.join(samples, "key_name").select("key_name", "n", F.transform("_s", lambda x: x["_v"]).alias("sample_values"))
    out = out.withColumn("data_type", value_kind(F.col("sample_values")[0]))
    return out.join(F.broadcast(total)).withColumn("rate", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def observed(entries: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Key rows of a batch of (key, value, time), as upsert() takes them."""
    n = entries.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    samples = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("_a", F.col(value).alias("_v")))), lambda x: x["_v"]), 1, SAMPLES)
    # the earliest ten values per key are picked before they meet
    k = F.row_number().over(Window.partitionBy(key).orderBy("_a", value))
    few = n.withColumn("_k", k).where(F.col("_k") <= SAMPLES).groupBy(key).agg(samples.alias("sample_values"))
    sums = n.groupBy(key).agg(F.sum("_n").alias("occurrence_count"), F.min("_a").alias("first_seen"), F.max("_z").alias("last_seen"))
    out = sums.join(few, key).withColumnRenamed(key, "key_name")
    return out.withColumn("data_type", value_kind(F.col("sample_values")[0])).withColumn("status", F.lit("active"))


def upserted(library: DataFrame, batch: DataFrame) -> DataFrame:
    """The library after a batch: counts add up, first_seen, status and type stay, samples grow up to ten."""
    old = library.select("key_name", F.col("sample_values").alias("_old"))
    out = upsert(library, batch, ["key_name"], keep=["first_seen", "status", "data_type"], add=["occurrence_count"]).join(old, "key_name", "left")
    both = F.slice(F.array_distinct(F.concat(F.coalesce("_old", F.array().cast("array<string>")), F.coalesce("sample_values", F.array().cast("array<string>")))), 1, SAMPLES)
    return out.withColumn("sample_values", both).drop("_old")


def stats(library: DataFrame) -> DataFrame:
    return library.agg(
        F.count("*").alias("total_keys"),
        F.count_if(F.col("status") == "active").alias("active_keys"),
        F.count_if(F.col("status") == "deprecated").alias("deprecated_keys"),
        F.coalesce(F.sum("occurrence_count"), F.lit(0)).cast("long").alias("occurrences"),
    )


def active(library: DataFrame, samples: int = 5) -> DataFrame:
    """Active keys, most frequent first, with a few of their values."""
    return library.where("status = 'active'").withColumn("sample_values", F.slice("sample_values", 1, samples)).orderBy(F.desc("occurrence_count"), "key_name")


def stats_view(library: DataFrame) -> DataFrame:
    """All keys with up to ten of their values, most frequent first, and the time of the last analysis of any of them."""
    last = F.max("last_seen").over(Window.partitionBy(F.lit(1)))
    return library.withColumn("sample_values", F.slice("sample_values", 1, SAMPLES)).withColumn("last_analyzed", last).orderBy(F.desc("occurrence_count"), "key_name")


def manual_examples(library: DataFrame, keys: Sequence[str], samples: int = 3) -> DataFrame:
    """(pos, key_name, example) for each manual key: its normalised name, with a few values of the active key of that name."""
    asked = library.sparkSession.createDataFrame([(i, k.lower().replace(" ", "_").replace("-", "_")) for i, k in enumerate(keys)], "pos int, key_name string")
    known = active(library, samples).select(F.lower("key_name").alias("key_name"), "sample_values").groupBy("key_name").agg(F.first("sample_values").alias("_v"))
    quoted = F.array_join(F.transform("_v", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    line = F.when(F.size("_v") > 0, F.concat(F.lit("  - "), "key_name", F.lit(": e.g., "), quoted)).otherwise(F.concat(F.lit("  - "), "key_name"))
    return asked.join(known, "key_name", "left").select("pos", "key_name", line.alias("example"))


def analyse(sample: DataFrame, library: DataFrame, metadata: str, order: str, manual: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The analysis of a sample of the index, retrieval.probed() say: the library after it, and (vectors_sampled, keys_analyzed). An empty sample changes nothing."""
    found = profile(sample.where(F.col(metadata).isNotNull()), metadata, order)
    counts = sample.agg(F.count("*").alias("vectors_sampled")).join(found.agg(F.count("*").alias("keys_analyzed")))
    return analysed(library, found, manual), counts


def reset(library: DataFrame) -> DataFrame:
    return library.withColumns({"occurrence_count": F.lit(0).cast("long"), "sample_values": F.array().cast("array<string>")})


def deactivated(library: DataFrame, preserve: Sequence[str] = ()) -> DataFrame:
    """Active keys that no longer occur become deprecated, unless they are preserved."""
    gone = (F.col("status") == "active") & (F.col("occurrence_count") == 0) & ~F.col("key_name").isin(list(preserve))
    return library.withColumn("status", F.when(gone, "deprecated").otherwise(F.col("status")))


def deprecated(library: DataFrame, key: str) -> DataFrame:
    return library.withColumn("status", F.when(F.col("key_name") == key, "deprecated").otherwise(F.col("status")))


def without(library: DataFrame, key: str) -> DataFrame:
    return library.where(F.col("key_name") != key)


def seeded(library: DataFrame, now: object) -> DataFrame:
    """The library with the media keys, where they are missing."""
    spark = library.sparkSession
    rows = spark.createDataFrame([(k, t, MEDIA_SAMPLES.get(k, [])) for k, t in MEDIA_KEYS.items()], "key_name string, data_type string, sample_values array<string>")
    rows = rows.withColumns({"occurrence_count": F.lit(0).cast("long"), "first_seen": F.lit(now).cast("timestamp"), "last_seen": F.lit(now).cast("timestamp"), "status": F.lit("active")})
    return upsert(library, rows, ["key_name"], keep=library.columns)


def analysed(library: DataFrame, found: DataFrame, manual: Sequence[str] | None = None) -> DataFrame:
    """The library after profile(): types and samples are replaced, counts stay, the status follows the manual list if there is one."""
    new = found.select("key_name", "data_type", "sample_values")
    t, s = library.alias("t"), new.alias("s")
    out = t.join(s, F.col("t.key_name") == F.col("s.key_name"), "full")
    name = F.coalesce("t.key_name", "s.key_name")
    touched = F.col("s.key_name").isNotNull()
    status = F.when(touched, "active").otherwise(F.col("t.status"))
    if manual is not None:
        status = F.when(name.isin(list(manual)), "active").when(touched, "inactive").otherwise(F.col("t.status"))
    return out.select(
        name.alias("key_name"),
        F.coalesce("s.data_type", "t.data_type").alias("data_type"),
        F.coalesce("s.sample_values", "t.sample_values").alias("sample_values"),
        F.coalesce("t.occurrence_count", F.lit(0)).alias("occurrence_count"),
        "t.first_seen",
        "t.last_seen",
        status.alias("status"),
    )


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks; nulls have none."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar(library: DataFrame, name: str, threshold: float = 0.8, most: int = 5, key: str = "key_name") -> DataFrame:
    """Keys that are spelled nearly like name: blanks, dashes and case make no difference."""
    form = F.translate(F.lower(F.trim(F.col(key))), "- ", "__")
    asked = name.strip().lower().replace("-", "_").replace(" ", "_")
    scored = library.select(key, F.bround(block_ratio(F.lit(asked), form), 2).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(most)


def suggested_filter(query: str, keys: Sequence[tuple[str, Sequence[str]]], allowed: Sequence[str] | None = None) -> dict | None:
    """A filter from a question: keys one of whose sample values the question names. The default of what a language model may do instead."""
    words = " " + " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split()) + " "
    out: dict = {}
    for key, values in keys:
        hits = [v for v in values if v and f" {v.lower()} " in words]
        if hits and (allowed is None or key in allowed):
            out[key] = {"$eq": hits[0].lower()} if len(hits) == 1 else {"$in": [h.lower() for h in hits]}
    return out or None


def filter_examples(library: DataFrame, n: int = 6) -> list[dict]:
    """Examples of filters over the ten most frequent keys (ten rows come to the driver); those that name unknown keys are dropped."""
    rows = active(library, 3).limit(10).collect()
    known = [r.key_name for r in rows]
    made = [{"name": f"{r.key_name} is {r.sample_values[0]}", "filter": {r.key_name: {"$eq": r.sample_values[0]}}} for r in rows if r.sample_values]
    return [e for e in made if names_only(e["filter"], known)][:n]
