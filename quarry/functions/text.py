"""Text functions: titles, front matter, chunks, snippets, time stamps, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, OVERLAP = 800, 120
#: Words whose meaning hangs on what was said before.
PRONOUNS = ["it", "this", "that", "these", "those", "he", "she", "they", "him", "her", "them"]


def unless_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def page_title(html: Column) -> Column:
    """The og:title, else the title element, else the first heading; null if none has text."""
    og = F.regexp_extract(html, '(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)
    title = F.regexp_extract(html, "(?is)<title[^>]*>([^<]*)</title>", 1)
    h1 = F.regexp_extract(html, "(?is)<h1[^>]*>([^<]*)</h1>", 1)
    return F.coalesce(unless_blank(og), unless_blank(title), unless_blank(h1))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0B]+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping runs of words; the last one ends with the text."""
    t = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, size), " "))


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def truncated(text: Column, n: int, marker: str = "\n\n[truncated]") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def clock(seconds: Column) -> Column:
    """M:SS, minutes beyond an hour too."""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def fragment_url(url: Column, start: Column, end: Column) -> Column:
    tail = F.concat(F.lit("#t="), start.cast("string"), F.coalesce(F.concat(F.lit(","), end.cast("string")), F.lit("")))
    return F.concat(url, F.coalesce(F.when(start.isNotNull(), tail), F.lit("")))


def front_matter(text: Column, field: str) -> Column:
    """A field of the front matter without the quotation marks around it; null if it is missing."""
    raw = F.regexp_extract(text, f"(?m)^\\s*{field}:[ \\t]*(.*?)[ \\t]*$", 1)
    plain = F.regexp_replace(F.regexp_replace(raw, '^"(.*)"$', "$1"), "^'(.*)'$", "$1")
    return F.nullif(plain, F.lit(""))


def image_caption(text: Column) -> Column:
    """An image's caption: the first user_caption or ai_caption between lines of three dashes, else the first line behind them that is no heading, cut to 200 characters."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("ended"), F.lit(None).cast("string").alias("caption"))

    def step(s: Column, line: Column) -> Column:
        t = F.btrim(line, F.lit(" \t\r\f\x0b"))
        edge = t == "---"
        said = F.nullif(F.btrim(F.regexp_replace(t, "^(user|ai)_caption:", "")), F.lit(""))
        named = F.when(s["inside"] & t.rlike("^(user|ai)_caption:"), said)
        body = F.when(s["ended"] & (t != "") & ~F.startswith(t, F.lit("#")), F.substring(t, 1, 200))
        caption = F.when(s["caption"].isNotNull(), s["caption"]).when(~edge, F.coalesce(named, body))
        return F.struct(F.when(edge, ~s["inside"]).otherwise(s["inside"]).alias("inside"), (s["ended"] | (edge & s["inside"])).alias("ended"), caption.alias("caption"))

    return F.aggregate(F.split(text, "\n", -1), start, step, lambda s: s["caption"])


def file_of(uri: Column, default: str = "document") -> Column:
    """The last part of an address, or the default."""
    return F.coalesce(F.nullif(F.element_at(F.split(uri, "/", -1), -1), F.lit("")), F.lit(default))


def file_type(filename: Column) -> Column:
    """What stands behind the last dot, or unknown."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.element_at(F.split(filename, "[.]", -1), -1))).otherwise("unknown")


def document_id(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "content/([a-f0-9-]{36})/", 1), F.lit(""))


def numeric_id(text: Column) -> Column:
    """The first number of ten digits and more."""
    return F.nullif(F.regexp_extract(text, "\\b([0-9]{10,})\\b", 1), F.lit(""))


def ambiguous(text: Column) -> Column:
    return text.rlike("(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(PRONOUNS) + ")($|[^\\p{L}\\p{N}_])")


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(filename, "/"), -1), "(?<=.)[.][^.]*$", "")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, "[.]([^./]*)$", 1))


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length, of trimmed lower-case strings."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))


def route(filename: Column) -> Column:
    """How a file is processed: text, passthrough, media or ocr."""
    e = extension(filename)
    return (
        F.when(e == "md", "passthrough")
        .when(e.isin("txt", "html", "htm", "csv", "tsv", "json", "xml", "eml", "epub", "docx", "xlsx"), "text")
        .when(e.isin("mp4", "webm", "mp3", "wav", "m4a", "ogg", "flac", "mov", "avi", "mkv"), "media")
        .otherwise("ocr")
    )


def page_ranges(total: Column, size: int = 10) -> Column:
    """(first, last) of runs of pages."""
    return F.transform(F.sequence(F.lit(1), total, F.lit(size)), lambda s: F.struct(s.alias("first"), F.least(s + size - 1, total).alias("last")))
