"""File types by content, as column expressions: a confidence per format, and the first format that is sure enough.

Only archives are looked into by a Pandas UDF, which reads their directory and no more than one small entry; other rows pass it as nulls.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD = 4096
#: The type that an extension stands for.
EXTENSIONS = {"html": "html", "htm": "html", "json": "json", "xml": "xml", "csv": "csv", "tsv": "csv", "txt": "txt", "eml": "eml", "epub": "epub", "docx": "docx", "xlsx": "xlsx", "mp4": "video", "mov": "video", "webm": "video", "m4v": "video", "mp3": "audio", "wav": "audio", "m4a": "audio", "ogg": "audio", "oga": "audio", "flac": "audio"}
#: Brands of ISO media files that are video and audio, second bytes of an MPEG audio frame.
VIDEO_BRANDS, AUDIO_BRANDS, FRAMES = ["isom", "iso2", "mp41", "mp42", "avc1", "qt  ", "M4V "], ["M4A ", "M4B ", "mp4a"], ["FB", "FA", "F3", "F2", "E3", "E2"]
#: Elements of HTML that are counted, marks of HTML that are no XML, header fields of mails.
HTML_TAGS = ["div", "p", "span", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "li", "a", "img"]
HTML_ONLY = ["<!doctype", "<html", "<head", "<body", "<div", "<span", "<p>", "</p>"]
MAIL_REQUIRED = ["from", "to", "subject"]
MAIL_OPTIONAL = ["date", "cc", "bcc", "reply-to", "message-id", "mime-version", "content-type"]


def result(kind: str | Column, confidence: float | Column) -> Column:
    """struct(type, confidence)."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value(kind).cast("string").alias("type"), value(confidence).cast("double").alias("confidence"))


def hint(filename: Column) -> Column:
    """The type that the extension stands for, or null."""
    extension = F.lower(F.regexp_extract(filename, "[^/][.]([^./]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), extension)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def media(content: Column, hinted: Column | None = None) -> Column:
    """result() by the leading bytes, by the extension alone where they say nothing, or null."""
    hinted = F.lit(None).cast("string") if hinted is None else hinted
    at = lambda pos, text: F.substring(content, pos, len(text)) == F.lit(text.encode("latin-1"))
    of = lambda kind: F.coalesce(hinted == kind, F.lit(False))
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    base = at(5, "ftyp") & (F.length(content) >= 12)
    container, ogg = at(1, "\x1a\x45\xdf\xa3"), at(1, "OggS")
    has = lambda text: F.contains(head, F.lit(text))
    out = F.when(base & brand.isin(VIDEO_BRANDS), result("video", 0.95)).when(base & brand.isin(AUDIO_BRANDS), result("audio", 0.95))
    out = out.when(base & of("audio"), result("audio", 0.85)).when(base & of("video"), result("video", 0.85)).when(base, result("video", 0.8))
    out = out.when(container & has("webm"), result("video", 0.95)).when(container & of("audio"), result("audio", 0.8)).when(container, result("video", 0.8))
    out = out.when(at(1, "ID3"), result("audio", 0.95)).when(at(1, "\xff") & F.hex(F.substring(content, 2, 1)).isin(FRAMES), result("audio", 0.9))
    out = out.when(at(1, "RIFF") & at(9, "WAVE"), result("audio", 0.95))
    out = out.when(ogg & (has("vorbis") | has("OpusHead")), result("audio", 0.95)).when(ogg & has("theora"), result("video", 0.95)).when(ogg & of("video"), result("video", 0.8)).when(ogg, result("audio", 0.8))
    return out.when(at(1, "fLaC"), result("audio", 0.95)).when(hinted.isin("video", "audio"), result(hinted, 0.6))


def is_zip(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "504B0304"


def archive_kind(file) -> tuple[str, float] | None:
    """epub, xlsx or docx, by the directory at the end of an open archive and its list of content types; None for others and damaged ones.

    A file that can seek is read at its end and at that one entry only.
    """
    try:
        with zipfile.ZipFile(file) as archive:
            names = archive.namelist()
            if "META-INF/container.xml" in names:
                return "epub", 0.95
            if "[Content_Types].xml" in names:
                try:
                    types = archive.read("[Content_Types].xml").decode("utf-8")
                except UnicodeDecodeError:
                    types = ""
                for kind, marks in (("xlsx", ("spreadsheetml", "xl/workbook.xml")), ("docx", ("wordprocessingml", "word/document.xml"))):
                    if any(m in types for m in marks):
                        return kind, 0.95
            for kind, folder in (("xlsx", "xl/"), ("docx", "word/")):
                if any(n.startswith(folder) for n in names):
                    return kind, 0.9
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError):
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def _archive_kinds(content: pd.Series) -> pd.DataFrame:
    found = [None if x is None else archive_kind(io.BytesIO(x)) for x in content]
    return pd.DataFrame([x or (None, None) for x in found], columns=["type", "confidence"])


def zip_kind(content: Column) -> Column:
    """result() of an archive of which archive_kind() knows the type; others have a null type."""
    return _archive_kinds(F.when(is_zip(content), content))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used; only where the expression itself is reached."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def html(text: Column) -> Column:
    """A document type, an html element with and without end, head and body, then elements by their starts and ends."""
    return F.when(~F.contains(text, F.lit("<")), 0.0).otherwise(bound(F.lower(text), _html))


def _html(low: Column) -> Column:
    has = lambda s: F.contains(low, F.lit(s))
    starts, ends = (reduce(add, [has(form.format(t)).cast("int") for t in HTML_TAGS]) for form in ("<{}", "</{}>"))
    out = F.when(low.rlike("^\\s*<!doctype html"), 0.95).when(has("<html") & has("</html>"), 0.9).when(has("<html"), 0.85)
    out = out.when(has("<head") & has("<body"), 0.8).when(has("<head") | has("<body"), 0.7)
    few = lambda n: F.when((n["starts"] >= 2) & (n["ends"] >= 2), 0.6).when((n["starts"] >= 2) & (n["ends"] >= 1), 0.5).when(n["starts"] >= 1, 0.4).otherwise(0.0)
    return out.otherwise(bound(F.struct(starts.alias("starts"), ends.alias("ends")), few))


def xml(text: Column) -> Column:
    """A declaration, a namespace, no HTML, one element around all, a single empty element, or elements with ends."""
    return F.when(~F.contains(text, F.lit("<")), 0.0).otherwise(bound(F.regexp_replace(text, "^\\s+|\\s+$", ""), _xml))


def _xml(t: Column) -> Column:
    of_html = bound(F.lower(t), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in HTML_ONLY]))
    starts, ends = (F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in ("<([a-zA-Z][a-zA-Z0-9_:-]*)[^>]*>", "</([a-zA-Z][a-zA-Z0-9_:-]*)>"))

    def elements(name: Column) -> Column:
        out = F.when((name != "") & F.endswith(t, F.concat(F.lit("</"), name, F.lit(">"))), 0.7).when((name != "") & F.endswith(t, F.lit("/>")), 0.65)
        pairs = lambda e: F.when((F.size(e["starts"]) >= 2) & (F.size(e["ends"]) >= 2) & F.arrays_overlap(e["starts"], e["ends"]), 0.6).otherwise(0.0)
        return out.otherwise(bound(F.struct(starts.alias("starts"), ends.alias("ends")), pairs))

    out = F.when(t.startswith("<?xml"), 0.95).when(F.contains(t, F.lit("xmlns")) & F.contains(t, F.lit("<")), 0.85).when(of_html, 0.0)
    return out.otherwise(bound(F.regexp_extract(t, "^<([a-zA-Z][a-zA-Z0-9_:-]*)", 1), elements))


def json(text: Column) -> Column:
    """A whole value, an object with a colon, or what begins as a list."""
    return F.when(text.rlike("^\\s*[{\\[]"), bound(F.regexp_replace(text, "^\\s+|\\s+$", ""), _json)).otherwise(0.0)


def _json(t: Column) -> Column:
    first = F.substring(t, 1, 1)
    # as the one element of an array: what follows a value would otherwise pass unread
    valid = F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))
    return F.when(first.isin("{", "[") & valid, 0.9).when((first == "{") & F.contains(t, F.lit(":")), 0.3).when(first == "[", 0.2).otherwise(0.0)


def _blank(line: Column) -> Column:
    return ~line.rlike("\\S")


def mail(text: Column) -> Column:
    """Header lines among the first twenty, up to the first blank one."""

    def names(lines: Column) -> Column:
        heads = bound(F.array_position(F.transform(lines, _blank), F.lit(True)), lambda blank: F.slice(lines, 1, F.when(blank > 0, blank - 1).otherwise(F.size(lines)).cast("int")))
        return F.transform(heads, lambda x: F.lower(F.regexp_extract(x, "^\\s*([A-Za-z-]+):", 1)))

    def counts(names: Column) -> Column:
        count = lambda wanted: F.size(F.filter(names, lambda x: x.isin(*wanted)))
        return F.struct(count(MAIL_REQUIRED).alias("required"), count(MAIL_REQUIRED + MAIL_OPTIONAL).alias("every"))

    sure = lambda n: F.when((n["required"] >= 2) & (n["every"] >= 3), 0.9).when(n["required"] >= 2, 0.8).when(n["every"] >= 2, 0.6).otherwise(0.0)
    return bound(bound(bound(F.slice(F.split(text, "\n"), 1, 20), names), counts), sure)


def csv(text: Column) -> Column:
    """A delimiter that all of the first five lines have equally often; as many columns in four of five rows, whatever their number; a head of short cells."""
    return bound(text, _csv)


def _csv(text: Column) -> Column:
    marks = {",": ",", "\t": "\t", ";": ";", "|": "[|]"}
    # two arguments would make a function of value and index
    times = lambda mark: lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))

    def best(lines: Column) -> Column:
        """The mark that the first five lines have equally often; of several the most frequent, and the first of those."""

        def even(first_five: Column) -> Column:
            alike = lambda place: lambda c: F.struct(F.when((F.array_min(c) > 0) & (F.array_min(c) == F.array_max(c)), -F.array_min(c)).otherwise(0).alias("n"), F.lit(place).alias("place"))
            return F.array_min(F.array(*(bound(F.transform(first_five, times(mark)), alike(place)) for place, mark in enumerate(marks))))

        found = bound(bound(F.filter(F.slice(lines, 1, 5), lambda x: ~_blank(x)), even), lambda b: F.when(b["n"] < 0, b["place"]))
        return F.when(F.size(F.filter(lines, lambda x: ~_blank(x))) >= 2, found)

    def confidence(mark: str, pattern: str) -> Column:
        # quoted fields hold no delimiters and no ends of rows; two quotes are one
        bare = F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), f'(?m)(^|{pattern})"[^"]*"', "$1")
        cells = F.split(F.regexp_replace(F.get(F.split(text, "\r?\n"), F.lit(0)), '"', ""), pattern)

        def of_rows(rows: Column) -> Column:
            head = (F.get(rows, F.lit(0)) != "") & F.forall(cells, lambda x: (F.length(x) < 50) & ~x.startswith(" "))

            def of_columns(columns: Column) -> Column:
                # four of five, without a division: quoted fields may leave no filled row
                steady = lambda width: F.coalesce((width >= 2) & (F.size(F.filter(columns, lambda c: c == width)) * 5 >= F.size(columns) * 4), F.lit(False))
                return F.when(~bound(F.get(columns, F.lit(0)), steady), 0.0).when(F.size(rows) < 3, 0.5).when(head, 0.85).otherwise(0.7)

            columns = F.transform(F.transform(F.filter(rows, lambda x: x != ""), times(mark)), lambda n: n + 1)
            return F.when(F.size(rows) < 2, 0.0).otherwise(bound(columns, of_columns))

        return F.coalesce(bound(F.split(F.regexp_replace(bare, "\r?\n\\z", ""), "\r?\n"), of_rows), F.lit(0.0))

    def by_mark(best: Column) -> Column:
        out = F.when(best.isNull() | text.rlike("\r[^\n]"), 0.0)
        for place, (mark, pattern) in enumerate(marks.items()):
            out = out.when(best == place, confidence(mark, pattern))
        return out.otherwise(0.0)

    return bound(bound(F.split(F.regexp_replace(text, "^\\s+|\\s+$", ""), "\n"), best), by_mark)


def sniffed(content: Column, filename: Column) -> Column:
    """struct(type, confidence): media, archives, the formats of text that are sure enough, those that are likely, the extension.

    Empty content is txt at 0.5, all that nothing else fits txt at 0.7. Each format is looked at once, and only where those before it are not sure enough.
    """
    # the archive's type comes from a UDF, which cannot stand within the other expressions
    return bound(F.struct(content.alias("content"), hint(filename).alias("hinted"), zip_kind(content).alias("packed")), _sniffed)


def _sniffed(file: Column) -> Column:
    content, hinted, packed = file["content"], file["hinted"], file["packed"]
    of = lambda kind: F.coalesce(hinted == kind, F.lit(False))

    def likely(page: Column, tree: Column, value: Column, table: Column) -> Column:
        out = F.when(~of("txt") & (table >= 0.7), result("csv", table))
        out = out.when((page >= 0.5) & of("html"), result("html", F.greatest(page, F.lit(0.7)))).when(page >= 0.5, result("html", page)).when((page >= 0.4) & of("html"), result("html", F.greatest(F.round(page + 0.3, 6), F.lit(0.7))))
        out = out.when(tree >= 0.6, result("xml", tree)).when((tree >= 0.4) & of("xml"), result("xml", F.greatest(F.round(tree + 0.3, 6), F.lit(0.7)))).when(value >= 0.5, result("json", value))
        return out.when(of("csv") & (table >= 0.5), result("csv", table)).when(hinted.isNotNull() & ~of("txt"), result(hinted, 0.6)).otherwise(result("txt", 0.7))

    def of_text(text: Column) -> Column:
        step = lambda kind, sure, least, rest: F.when(sure >= least, result(kind, sure)).otherwise(rest)
        letters = lambda page, tree, value: bound(mail(text), lambda letter: step("eml", letter, 0.7, bound(csv(text), lambda table: likely(page, tree, value, table))))
        values = lambda page, tree: bound(json(text), lambda value: step("json", value, 0.8, letters(page, tree, value)))
        trees = lambda page: bound(xml(text), lambda tree: step("xml", tree, 0.8, values(page, tree)))
        return bound(html(text), lambda page: step("html", page, 0.8, trees(page)))

    known = lambda played: F.when(played.isNotNull(), played).when(packed["type"].isNotNull(), packed).otherwise(bound(decoded(content), of_text))
    return F.when(content.isNull() | (F.length(content) == 0), result("txt", 0.5)).otherwise(bound(media(content, hinted), known))
