"""Metadata normalisation as column expressions: searchable arrays, reduction, key hygiene, typing, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_VALUES, MAX_CHARS, MIN_TOKEN = 10, 100, 3
#: Metadata keys that only the system may write, and key parts that mark sensitive values.
RESERVED = ["text_content", "s3_uri", "document_id", "embedding", "vector_id", "chunk_id", "chunk_index"]
CORE = ["content_type", "document_id", "document_type", "duration_seconds", "filename", "main_topic", "segment_index", "timestamp_end", "timestamp_start"]
SENSITIVE = ["query", "message", "content", "body", "token", "password", "secret", "key", "authorization", "credential", "apikey", "api_key", "access_token", "refresh_token", "id_token"]


def expand(value: Column) -> Column:
    """A string as words, then phrases: at most ten search terms."""
    s = F.substring(F.lower(F.trim(value)), 1, MAX_CHARS)
    listed = F.translate(s, ";|/", ",,,")
    parts = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: F.contains(listed, F.lit(",")) & (F.length(x) >= MIN_TOKEN))
    tokens = F.split(F.regexp_replace(F.translate(s, ";|/,", "    "), "[ \\t\\n\\r\\f]+", " "), " ")
    tokens = F.filter(F.transform(tokens, lambda x: F.regexp_replace(x, "^[().'\"]+|[().'\"]+$", "")), lambda x: F.length(x) >= MIN_TOKEN)
    year = F.regexp_extract(s, r"\b(1[89]\d{2}|20\d{2})\b", 1)
    years = F.when(year != "", F.array(year)).otherwise(F.array().cast("array<string>"))
    whole = F.when(s != "", F.array(s)).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(parts, tokens, years, whole))
    words = F.filter(every, lambda x: ~F.contains(x, F.lit(" ")))
    phrases = F.filter(every, lambda x: F.contains(x, F.lit(" ")))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.slice(F.concat(words, phrases), 1, MAX_VALUES))


def expand_all(values: Column) -> Column:
    """The terms of a list: single words before phrases, at most ten."""
    every = F.array_distinct(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), expand)))
    return F.slice(F.concat(F.filter(every, lambda x: ~F.contains(x, F.lit(" "))), F.filter(every, lambda x: F.contains(x, F.lit(" ")))), 1, MAX_VALUES)


def terms(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, terms): what expand_all() gives for the sorted distinct values of each group, with no more than ten terms of each group in one place."""
    each = df.select(by, value).where(F.col(value).isNotNull()).distinct().select(by, value, F.posexplode(expand(F.col(value))).alias("_i", "_term"))
    first = each.groupBy(by, "_term").agg(F.min(F.struct(value, "_i")).alias("_at"))
    phrase = F.contains("_term", F.lit(" "))
    k = F.row_number().over(Window.partitionBy(by).orderBy(phrase, "_at"))
    top = first.withColumn("_k", k).where(F.col("_k") <= MAX_VALUES)
    return top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_term"))), lambda x: x["_term"]).alias("terms"))


def reduce(metadata: Column, level: int, core: list[str] = CORE) -> Column:
    """map<string,array<string>>: 1 as it is, 2 with other than core values cut to three, 3 core keys only."""
    if level <= 1:
        return metadata
    if level == 2:
        return F.transform_values(metadata, lambda k, v: F.when(k.isin(core), v).otherwise(F.slice(v, 1, 3)))
    return F.map_filter(metadata, lambda k, v: k.isin(core))


def snake(key: Column) -> Column:
    return F.translate(F.lower(F.trim(key)), " -", "__")


def clean(metadata: Column, allowed: list[str] | None = None) -> Column:
    """map<string,string>: reserved and empty entries dropped, keys in snake case (the last of equal ones wins), values cut and lowered."""
    m = F.transform_values(metadata, lambda k, v: F.trim(F.lower(F.substring(v, 1, MAX_CHARS))))
    m = F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & ~snake(k).isin(RESERVED))
    if allowed is not None:
        m = F.map_filter(m, lambda k, v: snake(k).isin(allowed))
    return F.transform_keys(m, lambda k, v: snake(k))


def clean_list(values: Column) -> Column:
    """array<string>: the first ten values, trimmed and lowered; blank ones and those over 100 characters go."""
    low = F.transform(F.slice(values, 1, MAX_VALUES), lambda v: F.trim(F.lower(v)))
    return F.filter(low, lambda v: v.isNotNull() & (v != "") & (F.length(v) <= MAX_CHARS))


def kind(value: Column) -> Column:
    """boolean, number, list or string of a variant."""
    s = F.schema_of_variant(value)
    return F.when(s == "BOOLEAN", "boolean").when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s.startswith("ARRAY"), "list").otherwise("string")


def first_value(values: Column) -> Column:
    """The first of a list without quotation marks around it; null for null and empty lists."""
    return F.btrim(F.get(values, F.lit(0)), F.lit('"'))


def unquote(value: Column) -> Column:
    """One pair of quotation marks around a value goes."""
    return F.regexp_replace(value, '^"([\\s\\S]*)"$', "$1")


def masked(key: Column, value: Column) -> Column:
    """Values of sensitive keys: the first ten characters and the length, or stars if short."""
    short = F.when(F.length(value) > 20, F.concat(F.substring(value, 1, 10), F.lit("...("), F.length(value).cast("string"), F.lit(" chars)"))).otherwise("***")
    return F.when(F.lower(key).rlike("|".join(SENSITIVE)), short).otherwise(value)


def overlay(default: Column, custom: Column) -> Column:
    """Two configurations of one type, the custom values before the default ones."""
    return F.map_zip_with(default, custom, lambda k, d, c: F.coalesce(c, d))


def inline(metadata: Column) -> Column:
    """map<string,array<string>> as a list of (key, type, value) attributes: five values joined, cut to 100 characters."""
    entries = F.filter(F.map_entries(metadata), lambda e: F.size(e["value"]) > 0)
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.lit("STRING").alias("type"), F.substring(F.array_join(F.slice(e["value"], 1, 5), ", "), 1, MAX_CHARS).alias("value")))


def filename(raw: Column) -> Column:
    """A file name without control characters; `unnamed` if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(raw, "[\\x00-\\x1f\\x7f]", "")), F.lit("")), F.lit("unnamed"))


def filename_ok(name: Column) -> Column:
    return ~name.rlike('[/\\\\"]') & ~F.contains(name, F.lit("..")) & (F.length(name) <= 255)


def ascii_title(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace(raw, "[^\\x00-\\x7F]", "")), 1, 256), F.lit("")), F.lit("Untitled"))


def caption(user: Column, made: Column) -> Column:
    return F.concat_ws(". ", F.nullif(F.trim(user), F.lit("")), F.nullif(F.trim(made), F.lit("")))


def number(value: Column) -> Column:
    """A decimal as a whole number where it is one, else as a double, in text form."""
    return F.when(value % 1 == 0, value.cast("bigint").cast("string")).otherwise(value.cast("double").cast("string"))


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$")
