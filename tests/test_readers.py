import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, readers
from quarry.sources.html import markdown


def archive(entries: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = archive({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>n</t></is></c></row><row><c t="b"><v>1</v></c><c><v>2.5</v></c></row><row><c><v>3</v></c></row></sheetData></worksheet>'})
EPUB = archive({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>', "o/book.opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Tale</dc:title></metadata><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>', "o/c.xhtml": "<html><body><h1>One</h1><p>Once.</p></body></html>"})
MAIL = b"From: a@x.org\nTo: b@y.org\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nHello there\n"
SAMPLES = [
    ("a.txt", b"plain words, with commas\nand lines", "txt", "plain words"),
    ("p.html", b"<!DOCTYPE html><html><head><title>T &amp; U</title></head><body><nav>menu</nav><main><h1>Head</h1><p>Some <b>bold</b> text.</p><ul><li>x</li><li>y</li></ul></main></body></html>", "html", "# Head\n\nSome **bold** text."),
    ("t.csv", b"name,age\nAnn,3\nBob,4\nCy,5\n", "csv", "- age (numeric): 3, 4, 5"),
    ("semi", b"name;age\nAnn;3\nBob;4\nCy;5\n", "csv", "3 records, 2 columns"),
    ("o.json", b'{"a": {"b": [1, 2]}, "c": "x"}', "json", "- a: dict (b)"),
    ("x.xml", b'<?xml version="1.0"?><r xmlns:n="u"><i k="1">one</i><i>two</i></r>', "xml", "- i: 2 (k)"),
    ("m.eml", MAIL, "eml", "# Grüße"),
    ("d.docx", DOCX, "docx", "# Top\n\n**bold** text\n\n| a | b |"),
    ("s.xlsx", XLSX, "xlsx", "| Yes | 2.50 |"),
    ("b.epub", EPUB, "epub", "# Tale\n\n# One\n\nOnce."),
    ("latin.txt", "café".encode("latin-1"), "txt", "café"),
    ("empty.bin", b"", "txt", ""),
    ("song", b"ID3\x03rest", "audio", "ID3"),
    ("clip", b"\0\0\0\x18ftypmp42", "video", ""),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(n, c) for n, c, _, _ in SAMPLES] + [("none", None)], "filename string, content binary")
    return {r.filename: r for r in readers.extracted(df).collect()}


@pytest.mark.parametrize("name,content,kind,part", SAMPLES, ids=[s[0] for s in SAMPLES])
def test_types_and_markdown(read, name, content, kind, part):
    assert read[name].file_type == kind
    assert part in read[name].markdown
    assert read[name].parse_warning is None


def test_metadata_and_damage(spark, read):
    about = {n: json.loads(r.structural_metadata) for n, r in read.items()}
    assert about["o.json"] == {"structure_type": "object", "max_depth": 3, "top_level_keys": ["a", "c"], "key_count": 2}
    assert about["t.csv"]["sample_values"]["name"] == ["Ann", "Bob", "Cy"] and about["s.xlsx"]["total_rows"] == 2
    assert read["p.html"].title == "T & U" and about["p.html"]["has_main_element"] is True
    assert about["m.eml"]["date"].startswith("2024-01-01T10:00") and read["none"].markdown == ""
    for kind, data in (("json", b"{broken"), ("xml", b"<?xml version='1.0'?><a>"), ("docx", b"PK\x03\x04 broken"), ("xml", b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")):
        row = readers.read(data, "f", kind)
        assert row["parse_warning"] and row["markdown"] == readers.text_of(data)


def test_html_cases():
    assert markdown("<body><article><p>Inner</p></article><p>outer</p></body>") == ("Inner", True)
    assert markdown("<p>a<br>b</p><ol><li>x<li>y</ol><pre><code>k  = 1\n</code></pre>")[0].startswith("a\nb")
    assert markdown('<div role="navigation">menu</div><div class="ads x">buy</div>text <a href="/u">link</a>')[0] == "text link"
    assert markdown(None) == ("", False) and markdown("<<<>&&") != None  # noqa: E711


def test_archives_sidecars_and_uris(spark, tmp_path):
    data = archive({"a/x.png": b"1", "y.jpg": b"22", "../z.png": b"3", "__MACOSX/q.png": b"4", "readme.txt": b"5", "captions.json": json.dumps({"a/x.png": "first", "y.jpg": "second"})})
    df = spark.createDataFrame([("z1", data), ("bad", b"no zip"), ("null", None)], "path string, content binary")
    assert sorted((r.name, r.size, r.caption) for r in files.images_of_zips(df).collect()) == [("a/x.png", 1, "first"), ("y.jpg", 2, "second")]
    (tmp_path / "k.txt").write_text("hello")
    (tmp_path / "k.txt.metadata.json").write_text("{}")
    (tmp_path / "pages_11-20.txt").write_text("two")
    assert files.listed(spark, str(tmp_path)).count() == 2
    assert [(r.page_start, r.page_end, r.text) for r in files.partial_files(spark, str(tmp_path)).collect()] == [(11, 20, "two")]
    assert files.texts(spark, str(tmp_path), most=4, pattern="*.txt").count() == 1
    uris = spark.createDataFrame([("s3://b/k/x.txt",), ("https://s3.eu-west-1.amazonaws.com/b/k",), ("ftp://x",), (None,)], "u string")
    assert [r.p and tuple(r.p) for r in uris.select(files.uri_parts(F.col("u")).alias("p")).collect()] == [("b", "k/x.txt"), ("b", "k"), None, None]
    side = files.sidecars(spark.createDataFrame([("u1", {"topic": "Old Maps", "x": None})], "uri string, m map<string,string>"), "uri", "m")
    row = files.with_sidecars(spark.createDataFrame([("u1",), ("u2",)], "uri string"), side, "uri").orderBy("uri").collect()
    assert row[0].attributes["topic"] == ["old", "maps", "old maps"] and row[1].attributes is None


def test_mail_headers_are_those_of_the_full_parser(monkeypatch):
    from email import message_from_bytes, policy

    from quarry.sources import readers

    values = ["a@x.org", "a.b-c@x-y.org", "Ann B <a@x.org>", "a@x.org, b@x.org", "=?utf-8?q?=C3=A4?= <a@x.org>", "a b@c", "a..b@c", '"q" <a@x>', "a\r\n b", "two  blanks", "=?utf-8?q?=C3=A4?=", "", "a (comment)"]
    for v in values:
        data = f"From: {v}\r\nTo: b@x.org\r\nSubject: {v}\r\nSubject: other\r\nDate: Fri, 05 Jan 2024 10:00:00 +0000\r\n\r\nbody\r\n".encode()
        message, about = message_from_bytes(data, policy=policy.default), readers.read_mail(data, "m")[2]
        assert (about.get("from", ""), about.get("subject", "")) == (str(message["From"]), str(message["Subject"])), v
    calls = []
    monkeypatch.setattr(readers, "parsed_header", lambda name, value: calls.append(name) or value)
    readers.read_mail(b"From: a@x.org\r\nTo: b@x.org\r\nSubject: Order 1\r\n\r\nbody\r\n", "m")
    assert not calls


@pytest.mark.parametrize("name", ["read_text_files", "sniff_files"])
def test_rows_of_one_file_are_dealt_over_all_cores(spark, name):
    from quarry.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan
