"""Readers of file formats: bytes to Markdown with structural metadata.

extracted() sniffs the type as a column expression, then one Arrow pass reads each file by a small function of the
registry. A damaged file is never an error: it becomes plain text with a warning.
"""

from __future__ import annotations

import csv
import html as entities
import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import markdown
from .sniff import sniffed

RESULT = "markdown string, title string, word_count long, structural_metadata string, parse_warning string"
#: An archive's entry may not be larger than this, unpacked.
MOST_ENTRY = 50 << 20
NUMBER, DATE = re.compile(r"[-+]?[$€£]?\d[\d,]*\.?\d*%?"), re.compile(r"\d{4}-\d{2}-\d{2}([T ].*)?|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}")


def text_of(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def stem(name: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", name.rsplit("/", 1)[-1])


def read_text(data: bytes, name: str) -> tuple[str, str, dict]:
    text = text_of(data)
    return text, stem(name), {"line_count": text.count("\n") + 1 if text else 0, "char_count": len(text)}


def read_html(data: bytes, name: str) -> tuple[str, str, dict]:
    page = text_of(data)
    body, main = markdown(page)
    found = re.search(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]+)"|<title[^>]*>([^<]+)</title>|<h1[^>]*>([^<]+)</h1>', page)
    title = entities.unescape(next(x for x in found.groups() if x)).strip() if found else stem(name)
    return body, title, {"has_main_element": main, "original_size": len(data)}


def delimiter(text: str) -> str:
    """The mark that occurs most often and almost equally often in the first lines."""
    lines = [x for x in text.splitlines()[:10] if x.strip()]
    counts = {m: [x.count(m) for x in lines] for m in ",\t;|"}
    even = {m: sum(c) / len(c) for m, c in counts.items() if c and min(c) > 0 and max(c) - min(c) <= 1}
    return max(even, key=even.get) if even else ","


def column_kind(values: list[str]) -> str:
    """numeric or date if more than seven of ten of the first twenty values are."""
    some = [v.strip() for v in values if v.strip()][:20]
    for kind, pattern in (("date", DATE), ("numeric", NUMBER)):
        if some and sum(bool(pattern.fullmatch(v)) for v in some) / len(some) > 0.7:
            return kind
    return "text"


def read_csv(data: bytes, name: str) -> tuple[str, str, dict]:
    text = text_of(data)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(text)) if any(x.strip() for x in r)]
    if not rows:
        return "", stem(name), {"row_count": 0, "columns": []}
    width = max(map(len, rows))
    head = all(x.strip() and not NUMBER.fullmatch(x.strip()) for x in rows[0]) and len(set(rows[0])) == len(rows[0]) and len(rows) > 1
    names = [x.strip() for x in rows[0]] + [f"Column{i + 1}" for i in range(len(rows[0]), width)] if head else [f"Column{i + 1}" for i in range(width)]
    body = rows[1:] if head else rows
    columns = {n: [r[i] if i < len(r) else "" for r in body] for i, n in enumerate(names)}
    kinds = {n: column_kind(v) for n, v in columns.items()}
    samples = {n: list(dict.fromkeys(x for x in v if x.strip()))[:3] for n, v in columns.items()}
    cell = lambda x: (x[:50] + "..." if len(x) > 50 else x).replace("|", "\\|")
    lines = [f"# {stem(name)}", "", f"{len(body)} records, {width} columns", "", *(f"- {n} ({kinds[n]}): {', '.join(samples[n])}" for n in names), ""]
    lines += ["| " + " | ".join(map(cell, names)) + " |", "|" + " --- |" * width, *("| " + " | ".join(cell(r[i]) if i < len(r) else "" for i in range(width)) + " |" for r in body[:5])]
    return "\n".join(lines), stem(name), {"row_count": len(body), "columns": names, "column_types": kinds, "sample_values": samples, "has_header": head}


def depth(value: object, level: int = 0) -> int:
    if level >= 10 or not isinstance(value, (dict, list)) or not value:
        return level
    return max(depth(v, level + 1) for v in (value.values() if isinstance(value, dict) else value))


def read_json(data: bytes, name: str) -> tuple[str, str, dict]:
    text = text_of(data)
    value = json.loads(text)
    about: dict = {"structure_type": {dict: "object", list: "array"}.get(type(value), type(value).__name__), "max_depth": depth(value)}
    lines = [f"# {stem(name)}", ""]
    if isinstance(value, dict):
        about |= {"top_level_keys": list(value)[:50], "key_count": len(value)}
        lines += [f"- {k}: {type(v).__name__}" + (f" ({', '.join(list(v)[:5])})" if isinstance(v, dict) else f" of {len(v)}" if isinstance(v, list) else "") for k, v in value.items()]
    elif isinstance(value, list):
        about["item_count"] = len(value)
        objects = [v for v in value[:5] if isinstance(v, dict)]
        common = sorted(set.intersection(*(set(o) for o in objects)))[:10] if objects else []
        lines += [f"{len(value)} items", *(f"- {k}" for k in common)]
    return "\n".join([*lines, "", "```json", json.dumps(value, indent=2, ensure_ascii=False)[:2000], "```"]), stem(name), about


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def safe_xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entities are not read")
    return ElementTree.fromstring(data)


def read_xml(data: bytes, name: str) -> tuple[str, str, dict]:
    root = safe_xml(data)
    elements = list(root.iter())
    counts = Counter(local(e.tag) for e in elements)
    spaces = list(dict.fromkeys(e.tag[1:].split("}")[0] for e in elements if e.tag.startswith("{")))
    names: dict[str, list[str]] = {}
    for e in elements:
        if e.attrib:
            names[local(e.tag)] = sorted({*names.get(local(e.tag), []), *map(local, e.attrib)})
    top = counts.most_common(20)
    text = " ".join(x.strip() for x in root.itertext() if x.strip())
    lines = [f"# {stem(name)}", "", f"Root: {local(root.tag)}", "", *(f"- {k}: {n}" + (f" ({', '.join(names[k][:5])})" if k in names else "") for k, n in top), *(f"- namespace {s}" for s in spaces[:5]), "", text]
    return "\n".join(lines), stem(name), {"root_element": local(root.tag), "namespaces": spaces, "element_counts": dict(counts), "attributes": names}


#: Values of header fields that the full parser gives back as they are: one plain address, printable words with single blanks and nothing encoded.
PLAIN_ADDRESS, PLAIN_TEXT = re.compile(r"[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*"), re.compile(r"(?!.*=\?)[!-~]+( [!-~]+)*")


@lru_cache(4096)
def parsed_header(name: str, value: str) -> str:
    return str(policy.default.header_fetch_parse(name, value))


def header(name: str, value: str) -> str:
    """A header field as the full parser has it, which plain values do not need."""
    plain = {"From": PLAIN_ADDRESS, "To": PLAIN_ADDRESS, "Cc": PLAIN_ADDRESS, "Subject": PLAIN_TEXT}.get(name)
    return value if plain and plain.fullmatch(value) else parsed_header(name, value)


def read_mail(data: bytes, name: str) -> tuple[str, str, dict]:
    message = message_from_bytes(data, policy=policy.default)
    raw: dict[str, str] = {}
    for k, v in message.raw_items():
        raw.setdefault(k.lower(), v)  # of fields that are repeated the first one counts
    part = message.get_body(("plain", "html"))
    body = part.get_content() if part else ""
    if part and part.get_content_type() == "text/html":
        body = markdown(body)[0]
    head = {k: v for k in ("From", "To", "Cc", "Subject") if k.lower() in raw and (v := header(k, raw[k.lower()]))}
    try:
        head["Date"] = parsedate_to_datetime(header("Date", raw["date"])).isoformat()
    except (KeyError, TypeError, ValueError):
        pass
    files = [x.get_filename() for x in message.iter_attachments() if x.get_filename()]
    title = head.get("Subject") or stem(name)
    lines = [f"# {title}", "", *(f"**{k}:** {v}" for k, v in head.items() if k != "Subject"), "", body.strip()]
    return "\n".join(lines), title, {**{k.lower(): v for k, v in head.items()}, "attachments": files, "has_attachments": bool(files)}


def entry(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_ENTRY:
        raise ValueError("an entry of the archive is too large")
    return archive.read(name)


def read_docx(data: bytes, name: str) -> tuple[str, str, dict]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = safe_xml(entry(z, "word/document.xml")).find(f"{w}body")
        core = safe_xml(entry(z, "docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    about = {local(e.tag): e.text for e in core if e.text}

    def paragraph(p) -> str:
        out = ""
        for r in p.iter(f"{w}r"):
            text = "".join(t.text or "" for t in r.iter(f"{w}t"))
            mark = ("**" if r.find(f"{w}rPr/{w}b") is not None else "") + ("*" if r.find(f"{w}rPr/{w}i") is not None else "")
            out += f"{mark}{text}{mark[::-1]}" if text.strip() else text
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.fullmatch(r"Heading(\d)", style.get(f"{w}val", "")) if style is not None else None
        return "#" * int(level[1]) + " " + out if level else out

    lines, tables, paragraphs = [], 0, 0
    for e in body:
        if local(e.tag) == "p" and (line := paragraph(e)).strip():
            paragraphs += 1
            lines += [line, ""]
        elif local(e.tag) == "tbl":
            tables += 1
            rows = [[" ".join(paragraph(p) for p in c.iter(f"{w}p")) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]
            for i, r in enumerate(rows):
                lines += ["| " + " | ".join(r) + " |"] + (["|" + " --- |" * len(r)] if i == 0 else [])
            lines.append("")
    return "\n".join(lines).strip(), about.get("title") or stem(name), {**about, "paragraph_count": paragraphs, "table_count": tables}


def sheet_cell(cell, shared: list[str], m: str) -> str:
    value, kind = cell.find(f"{m}v"), cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{m}t"))
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "Yes" if value.text == "1" else "No"
    try:
        x = float(value.text)
    except ValueError:
        return value.text
    return str(int(x)) if x == int(x) else f"{x:.2f}"


def read_xlsx(data: bytes, name: str) -> tuple[str, str, dict]:
    m, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in safe_xml(entry(z, "xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in safe_xml(entry(z, "xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        lines, sheets, total = [f"# {stem(name)}", ""], [], 0
        for i, s in enumerate(safe_xml(entry(z, "xl/workbook.xml")).iter(f"{m}sheet")):
            path = (targets.get(s.get(f"{r}id")) or f"worksheets/sheet{i + 1}.xml").lstrip("/")
            path = path if path.startswith("xl/") else "xl/" + path
            rows = [[sheet_cell(c, shared, m) for c in row.iter(f"{m}c")] for row in safe_xml(entry(z, path)).iter(f"{m}row")]
            rows = [x for x in rows if any(x)]
            sheets.append({"name": s.get("name"), "columns": rows[0] if rows else [], "rows": max(0, len(rows) - 1)})
            total += max(0, len(rows) - 1)
            lines += [f"## {s.get('name')}", ""] + ["| " + " | ".join(x) + " |" + ("\n|" + " --- |" * len(x) if k == 0 else "") for k, x in enumerate(rows[:11])] + [""]
    return "\n".join(lines).strip(), stem(name), {"sheet_count": len(sheets), "sheets": sheets, "total_rows": total}


def read_epub(data: bytes, name: str) -> tuple[str, str, dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = safe_xml(entry(z, "META-INF/container.xml"))
        path = next(e.get("full-path") for e in box.iter() if local(e.tag) == "rootfile")
        book = safe_xml(entry(z, path))
        folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
        items = {e.get("id"): e.get("href") for e in book.iter() if local(e.tag) == "item" and "html" in (e.get("media-type") or "")}
        spine = [e.get("idref") for e in book.iter() if local(e.tag) == "itemref"] or list(items)
        chapters = [x for i in spine if i in items and (x := markdown(text_of(entry(z, folder + items[i])))[0])]
    about = {local(e.tag): e.text for e in book.iter() if e.tag.startswith("{http://purl.org/dc/elements/1.1/}") and e.text}
    title = about.get("title") or stem(name)
    return "\n\n".join([f"# {title}", *chapters]), title, {**about, "chapter_count": len(chapters)}


READERS: dict[str, Callable[[bytes, str], tuple[str, str, dict]]] = {"txt": read_text, "md": read_text, "html": read_html, "csv": read_csv, "json": read_json, "xml": read_xml, "eml": read_mail, "docx": read_docx, "xlsx": read_xlsx, "epub": read_epub}


def read(data: bytes | None, name: str | None, kind: str) -> dict:
    """One file's row of RESULT."""
    data, name, warning = data or b"", name or "unnamed", None
    try:
        text, title, about = READERS.get(kind, read_text)(data, name)
    except Exception as e:  # damaged content of any format degrades to text
        text, title, about = read_text(data, name)
        warning = f"read as text: {type(e).__name__}"
    return {"markdown": text, "title": title, "word_count": len(text.split()), "structural_metadata": json.dumps(about, ensure_ascii=False, default=str), "parse_warning": warning}


def extracted(files: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """files without their content, with file_type, confidence and the columns of RESULT. No shuffle."""
    typed = files.withColumn("_s", sniffed(F.col(content), F.col(filename))).withColumns({"file_type": F.col("_s.type"), "confidence": F.col("_s.confidence")}).drop("_s")
    rest = [c for c in typed.columns if c != content]
    kinds = typed.select(*rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                rows = [read(d, n, k) for d, n, k in zip(*(part.column(c).to_pylist() for c in (content, filename, "file_type")), strict=True)]
                new = [pa.array([r[n] for r in rows], pa.int64() if n == "word_count" else pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *new], names=[*rest, *names])

    return typed.mapInArrow(run, f"{fields}, {RESULT}")
