"""Queries of file sniffers and readers over rows rendered as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import keyed, readers, sniff
from .registry import query


#: Elements of the HTML ladder, as the sniffer has them.
_TAGS = str(sniff.HTML_TAGS)


@query("pages", sql=f"""WITH t AS (SELECT page_id, lower(CASE page_id % 8 WHEN 0 THEN html WHEN 1 THEN '<html><body>x' WHEN 2 THEN ' <html>' || html || '</html>' WHEN 3 THEN '<head></head><body>' WHEN 4 THEN 'x <body> y'
  WHEN 5 THEN '<p>a</p><div>b</div>' WHEN 6 THEN '<p>a<span>b</p>' ELSE 'no <a href' END) AS t FROM pages),
c AS (SELECT *, len(list_filter({_TAGS}, lambda x: contains(t, '<' || x))) AS starts, len(list_filter({_TAGS}, lambda x: contains(t, '</' || x || '>'))) AS ends FROM t)
SELECT page_id, CAST(CASE WHEN starts_with(ltrim(t, ' ' || chr(9) || chr(10) || chr(13)), '<!doctype html') THEN 0.95 WHEN contains(t, '<html') AND contains(t, '</html>') THEN 0.9 WHEN contains(t, '<html') THEN 0.85
  WHEN contains(t, '<head') AND contains(t, '<body') THEN 0.8 WHEN contains(t, '<head') OR contains(t, '<body') THEN 0.7 WHEN starts >= 2 AND ends >= 2 THEN 0.6 WHEN starts >= 2 AND ends >= 1 THEN 0.5
  WHEN starts >= 1 THEN 0.4 ELSE 0 END AS DOUBLE) AS confidence FROM c""")
def sniff_html(pages):
    """Pages as they are and in seven forms that tell the steps of the ladder apart."""
    i, forms = F.col("page_id") % 8, [F.lit("<html><body>x"), F.concat(F.lit(" <html>"), "html", F.lit("</html>")), F.lit("<head></head><body>"), F.lit("x <body> y"), F.lit("<p>a</p><div>b</div>"), F.lit("<p>a<span>b</p>"), F.lit("no <a href")]
    text = F.when(i == 0, F.col("html"))
    for k, form in enumerate(forms):
        text = text.when(i == k + 1, form)
    return pages.select("page_id", sniff.html(text).cast("double").alias("confidence"))


@query("events", sql="""SELECT event_id, CAST([0.95, 0.85, 0.0, 0.7, 0.65, 0.6, 0.0][event_id % 7 + 1] AS DOUBLE) AS confidence FROM events""")
def sniff_xml(events):
    """Seven forms, one for each step."""
    forms = ['<?xml version="1.0"?><a/>', 'x <a xmlns="u">', "<a><div>x</div></a>", "<a x='1'><b>y</b></a>\n", "<a x='1'/> ", "y <a>1</a> <b>2</b>", "plain"]
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 7 + 1).cast("int"))
    return events.select("event_id", sniff.xml(text).cast("double").alias("confidence"))


@query("events", sql="SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS confidence FROM events WHERE props IS NOT NULL")
def sniff_json(events):
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.col("props")).when(i == 1, F.concat("props", F.lit(" and"))).when(i == 2, F.concat(F.lit("[1, "), "props")).otherwise(F.concat(F.lit("x "), "props"))
    return events.where("props is not null").select("event_id", sniff.json(text).cast("double").alias("confidence"))


@query("conversations", sql="SELECT conv_id, turn, CAST(CASE turn % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence FROM conversations")
def sniff_email(conversations):
    i = F.col("turn") % 5
    head = F.when(i == 0, "From: a\nTo: b\nDate: c\n\n").when(i == 1, "From: a\nTo: b\nSubject: c\n\n").when(i == 2, "from: a\r\nsubject: b\r\n\r\nDate: d\n").when(i == 3, "From: a\nReply-To: b\n\n").otherwise("plain\nFrom: x\n\nTo: y\n")
    return conversations.select("conv_id", "turn", sniff.mail(F.concat(head, F.lit("body"))).cast("double").alias("confidence"))


@query("pages", sql="""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS element FROM pages), c AS (SELECT page_id, element, count(*) AS n FROM t GROUP BY ALL)
SELECT page_id, element, n FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, element) <= 20""")
def xml_top_elements(pages):
    from pyspark.sql import Window

    each = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("element")).groupBy("page_id", "element").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "element"))
    return each.withColumn("_k", k).where("_k <= 20").drop("_k")


@query("supplier", sql="""SELECT 'supplier-' || (s_suppkey // 100) || '.csv' AS filename, 'csv' AS file_type, count(*) AS row_count, 'name,balance,day' AS columns, 'text,numeric,date' AS kinds FROM supplier GROUP BY ALL""")
def csv_type_inference(supplier):
    """Suppliers as CSV files of a hundred lines about with a header, read back by the CSV reader."""
    line = F.concat_ws(",", "s_name", F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit("2024-01-05"))
    rows = supplier.groupBy(F.concat(F.lit("supplier-"), F.expr("s_suppkey div 100").cast("string"), F.lit(".csv")).alias("filename")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    files = rows.select("filename", F.concat(F.lit("name,balance,day\n"), F.col("body")).cast("binary").alias("content"))
    out = readers.extracted(files)
    about = lambda path: F.get_json_object("structural_metadata", path)
    kinds = F.concat_ws(",", *(about(f"$.column_types.{c}") for c in ("name", "balance", "day")))
    columns = F.array_join(F.from_json(about("$.columns"), "array<string>"), ",")
    return out.select("filename", "file_type", about("$.row_count").cast("long").alias("row_count"), columns.alias("columns"), kinds.alias("kinds"))


@query("pages")
def html_to_markdown(pages):
    files = pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return readers.extracted(files).drop("filename")


def _about(path: str):
    return F.get_json_object("structural_metadata", path)


@query("customer", sql="""SELECT c_custkey AS id, 'json' AS file_type, CASE WHEN c_custkey % 2 = 0 THEN 'object' ELSE 'array' END AS structure_type, CASE WHEN c_custkey % 2 = 0 THEN 3 END AS key_count, CASE WHEN c_custkey % 2 = 1 THEN 2 END AS item_count,
  CASE WHEN c_custkey % 2 = 0 THEN 'id,tags,inner' END AS top_level_keys, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS max_depth, 'c' || c_custkey AS title FROM customer""")
def read_json_files(customer):
    """Customers as JSON files, objects and lists, sniffed and read."""
    key = F.col("c_custkey").cast("string")
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"id": '), key, F.lit(', "tags": ["a", "b"], "inner": {"x": {"y": 1}}}'))).otherwise(F.concat(F.lit('[{"id": '), key, F.lit('}, {"id": 0, "z": 2}]')))
    # as mails are: small rows are dealt over all cores first
    out = readers.extracted(customer.select("c_custkey").repartition("c_custkey").select(F.col("c_custkey").alias("id"), F.concat(F.lit("d/c"), key, F.lit(".json")).alias("filename"), body.cast("binary").alias("content")))
    keys = F.array_join(F.from_json(_about("$.top_level_keys"), "array<string>"), ",")
    return out.select("id", "file_type", _about("$.structure_type").alias("structure_type"), _about("$.key_count").cast("int").alias("key_count"), _about("$.item_count").cast("int").alias("item_count"), keys.alias("top_level_keys"), _about("$.max_depth").cast("int").alias("max_depth"), "title")


@query("supplier", sql="""SELECT s_suppkey AS id, 'xml' AS file_type, 'supplier' AS root_element, CAST(s_suppkey % 4 AS INTEGER) AS parts, 'urn:s' AS namespace, CAST(1 + s_suppkey % 4 AS BIGINT) AS words FROM supplier""")
def read_xml_files(supplier):
    """Suppliers as XML files with a namespace and up to three parts."""
    key = F.col("s_suppkey")
    parts = F.array_join(F.transform(F.when(key % 4 > 0, F.sequence(F.lit(1), (key % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit('<part n="'), i.cast("string"), F.lit('">word</part>'))), "")
    body = F.concat(F.lit('<?xml version="1.0"?><supplier xmlns="urn:s"><name>one</name>'), parts, F.lit("</supplier>"))
    out = readers.extracted(supplier.select(key.alias("id"), F.concat(F.lit("s"), key.cast("string"), F.lit(".xml")).alias("filename"), body.cast("binary").alias("content")))
    text = F.element_at(F.split("markdown", "\n"), -1)
    return out.select("id", "file_type", _about("$.root_element").alias("root_element"), F.coalesce(_about("$.element_counts.part").cast("int"), F.lit(0)).alias("parts"), _about("$.namespaces[0]").alias("namespace"), F.size(F.split(text, " ")).cast("long").alias("words"))


@query("orders", sql="""SELECT o_orderkey AS id, 'eml' AS file_type, 'Order ' || o_orderkey AS title, 'a@x.org' AS sender, false AS has_attachments, '**From:** a@x.org' || chr(10) || '**To:** b@x.org' || chr(10) || '**Date:** 2024-01-05T10:00:00+00:00' AS head FROM orders""")
def read_mail_files(orders):
    """Orders as mails, sniffed by their headers and read."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("From: a@x.org\r\nTo: b@x.org\r\nSubject: Order "), key, F.lit("\r\nDate: Fri, 05 Jan 2024 10:00:00 +0000\r\n\r\nHello there\r\n"))
    # small rows are dealt over all cores before they become files: a task would otherwise have all of a small input's
    out = readers.extracted(orders.select("o_orderkey").repartition("o_orderkey").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("m"), key).alias("filename"), body.cast("binary").alias("content")))
    head = F.array_join(F.filter(F.split("markdown", "\n"), lambda x: x.startswith("**")), "\n")
    return out.select("id", "file_type", "title", _about("$.from").alias("sender"), _about("$.has_attachments").cast("boolean").alias("has_attachments"), head.alias("head"))


@query("documents", sql=f"""SELECT doc_id AS id, 'txt' AS file_type, 'd' || doc_id AS title, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS BIGINT) AS word_count, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS line_count, coalesce(length(text), 0) AS char_count FROM documents""")
def read_text_files(documents):
    """Documents as text files, read as a whole."""
    key = F.col("doc_id").cast("string")
    # the rows of a file with one row group would all be one task's
    out = readers.extracted(documents.select("doc_id", "text").repartition("doc_id").select(F.col("doc_id").alias("id"), F.concat(F.lit("x/d"), key, F.lit(".txt")).alias("filename"), F.col("text").cast("binary").alias("content")))
    return out.select("id", "file_type", "title", "word_count", _about("$.line_count").cast("long").alias("line_count"), _about("$.char_count").cast("long").alias("char_count"))


#: Bytes in hexadecimal digits or text before and behind a document's text, extension, type, confidence.
_FILES = [
    ("", "", "txt", "txt", 0.7), ("", "", "bin", "txt", 0.7), ("<!doctype html>", "", "xml", "html", 0.95), ("<html>", "</html>", "txt", "html", 0.9), ("<html>", "", "", "html", 0.85), ("<head>", "<body>", "", "html", 0.8), ("<body>", "", "json", "html", 0.7),
    ("<p>a</p><div>", "</div>", "bin", "html", 0.6), ("<p>a</p><div>", "</div>", "htm", "html", 0.7), ("<?xml?>", "", "txt", "xml", 0.95), ("xmlns <", "", "", "xml", 0.85), ("<b>", "</b>", "bin", "xml", 0.7), ("From: a\nTo: b\nSubject: c\n\n", "", "txt", "eml", 0.9), ("From: a\nTo: b\n\n", "", "", "eml", 0.8), ("Date: a\nCc: b\n\n", "", "eml", "eml", 0.6),
    ("x'000000186674797069736F6D", "", "m4a", "video", 0.95), ("x'00000018667479704D344120", "", "mp4", "audio", 0.95), ("x'000000186674797064617368", "", "m4a", "audio", 0.85), ("x'1A45DFA3", "", "mp3", "audio", 0.8), ("x'494433", "", "", "audio", 0.95), ("x'FFFA", "", "", "audio", 0.9), ("x'4F676753", "", "webm", "video", 0.8), ("x'664C6143", "", "txt", "audio", 0.95), ("", "", "mov", "video", 0.6), ("", "", "docx", "docx", 0.6),
]
_TABLE = "(VALUES " + ", ".join(f"({i}, '{ext}', '{kind}', {confidence})" for i, (_, _, ext, kind, confidence) in enumerate(_FILES)) + ") f(i, ext, kind, confidence)"


@query("documents", sql=f"""SELECT doc_id, kind AS file_type, CAST(confidence AS DOUBLE) AS confidence FROM documents JOIN {_TABLE} ON length(coalesce(text, '')) % {len(_FILES)} = i""")
def sniff_files(documents):
    """Letters of each document's text in files of many forms; its length says which. One form for each step of the ladder."""
    text = F.concat(F.lit("w"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", ""))
    number = F.length(F.coalesce("text", F.lit(""))) % len(_FILES)
    content, extension = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for i, (head, tail, ext, _, _) in enumerate(_FILES):
        start = F.unhex(F.lit(head[2:])) if head.startswith("x'") else F.lit(head).cast("binary")
        content = F.when(number == i, F.concat(start, F.concat(text, F.lit(tail)).cast("binary"))).otherwise(content)
        extension = F.when(number == i, ext).otherwise(extension)
    found = sniff.sniffed(F.col("content"), F.concat(F.lit("dir.x/name."), F.col("extension")))
    # as in read_text_files: the rows of one row group are dealt over all cores first
    return documents.select("doc_id", "text").repartition("doc_id").select("doc_id", content.alias("content"), extension.alias("extension")).select("doc_id", found.alias("s")).select("doc_id", F.col("s.type").alias("file_type"), F.col("s.confidence").alias("confidence"))


@query("documents", sql="""WITH r AS (SELECT doc_id, coalesce(length(text), 0) AS k, (['|', ';', ','])[coalesce(length(text), 0) % 3 + 1] AS mark FROM documents)
SELECT doc_id, CAST(CASE WHEN k % 7 = 1 OR (k % 7 = 0 AND k % 5 < 4) THEN 0 WHEN k % 7 = 2 THEN 0.5 WHEN k % 7 = 3 THEN 0.7 ELSE 0.85 END AS DOUBLE) AS confidence FROM r""")
def sniff_csv(documents):
    """Tables of rows by the letters of each document's text: even ones, one column, two rows, a head of long cells, rows of another width far down."""
    word = F.concat(F.lit("w"), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", ""), 1, 20))
    rows = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("k"), word.alias("word"))
    k, word = F.col("k"), F.col("word")
    mark = F.element_at(F.array(*map(F.lit, ["|", ";", ","])), (k % 3 + 1).cast("int"))
    row = F.when(k % 7 == 1, word).otherwise(F.concat(word, mark, word, mark, word))
    head = F.when(k % 7 == 3, F.concat(F.repeat(F.lit("long "), F.lit(11)), mark, word, mark, word)).otherwise(row)
    others = F.when(k % 7 == 0, (F.lit(5) - k % 5) * 4).otherwise(0)  # of twenty rows below the first six
    body = F.concat(F.repeat(F.concat(F.lit("\n"), row), F.when(k % 7 == 2, 1).otherwise(5)), F.when(k % 7 == 2, "").otherwise(F.concat(F.repeat(F.concat(F.lit("\n"), row), F.lit(20) - others), F.repeat(F.concat(F.lit("\n"), row, mark, word), others))))
    return rows.select("doc_id", sniff.csv(F.concat(head, body)).cast("double").alias("confidence"))


@query("documents", sql="""WITH d AS (SELECT doc_id, encode(CASE WHEN lang = 'de' THEN 'replaced' ELSE coalesce(text, '') END) AS body FROM documents)
SELECT doc_id, octet_length(body) AS length, md5(body[1:4096]) AS head_md5, CAST(least(octet_length(body), 4096) AS BIGINT) AS bytes_read FROM d""")
def keyed_files(documents):
    """A file for each document, those of one language written again in place, and the heads of all of them read back."""
    folder = scratch(documents.sparkSession, "keyed")
    rows = documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), "text", "lang")
    rows = rows.repartition(keyed.folder(F.col("key"))).withColumn("key", keyed.spread(F.col("key")))
    keyed.write_keyed(rows, folder, "key")
    keyed.write_keyed(rows.where("lang = 'de'").withColumn("text", F.lit("replaced")), folder, "key")
    out = keyed.heads(documents.sparkSession, folder)
    return out.select(F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "length", F.md5("head").alias("head_md5"), "bytes_read")
