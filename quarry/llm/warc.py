"""Deterministic sharded WARC writer and reader.

Records are dealt into key ranges and sorted, written as one gzip member per record, and a file is rolled
when its compressed size passes ROLL_BYTES. Headers and digests are made anew from the payload, with a
fixed date and ids derived from the digest and the key, so the same rows give the same bytes.
Each file is written under a temporary name and renamed; a manifest (a row per file)
written after all of them commits the folder, and readers open only the files it lists. A lost executor's task is
done again and replaces its files by equal ones.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest key is a response and
the others are revisits that refer to it. Copies meet by a partial aggregation over digests; only digests that occur twice
are joined back, without payloads, and AQE splits a digest with very many copies. Payloads are shuffled once.

Defined results: a null payload is empty; null urls become urn:page:<key>; rows that repeat the smallest key are
responses each; a row with a null key is a response unless its payload has a row with a key; ties are sorted by url and digest. Payloads of any
length are written whole. Other columns of df are not written, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, range_id, shared_dir, total_bytes

#: A range holds RANGE_BYTES of payload about, its files ROLL_BYTES each after compression.
ROLL_BYTES, RANGE_BYTES, MIN_REVISIT, DATE = 16 << 20, 256 << 20, 100, "2024-01-01T00:00:00Z"
#: Tables of less than FEW_RANGES full ranges are dealt over that many, but no range holds less than LEAST_BYTES about.
FEW_RANGES, LEAST_BYTES = 64, 2 << 20
#: Characters of a url that stay as they are, fixed.
PLAIN = ":/?#[]@!$&'()*+,;=%~-._"


def with_revisits(df: DataFrame, key: str) -> DataFrame:
    """(key, _tie, _digest, _refers) of the rows (key, _tie, _digest, _size) that revisit another one; no payloads."""
    first = df.where(F.col("_size") >= MIN_REVISIT).groupBy("_digest").agg(F.min(key).alias("_refers"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(first, "_digest").where(F.col("_refers").isNotNull() & ~F.col(key).eqNullSafe(F.col("_refers"))).select(key, "_tie", "_digest", "_refers").distinct()


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record as a gzip member."""
    url = quote(url, safe=PLAIN) if url else f"urn:page:{key}"
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}/{k}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {name(key)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Key: {key}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Key: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """The rows of df as WARC files in folder, which must be visible to all executors (any file system that pyarrow opens)."""
    size = total_bytes(df, payload)  # the ranges hang on the data alone, never on the cluster
    parts = max(1, -(-size // range_bytes), min(FEW_RANGES, -(-size // LEAST_BYTES)))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(key, url, body.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256)).withColumn("_tie", F.xxhash64(url, "_digest"))
    # which rows are revisits is found without payloads; such marks then travel with the payloads and stand before their rows
    heads = kept(rows.select(key, "_tie", "_digest", F.length("_payload").alias("_size")), "digests")
    marks = with_revisits(heads, key)
    marks = marks.select(key, F.lit(None).cast(df.schema[url].dataType).alias(url), F.lit(None).cast("binary").alias("_payload"), "_digest", "_tie", "_refers")
    rows = rows.withColumn("_refers", F.lit(None).cast(df.schema[key].dataType)).unionByName(marks).withColumn("_part", range_id(heads, key, "_tie", parts))
    rows = rows.repartitionById(parts, "_part").sortWithinPartitions("_part", F.asc_nulls_first(key), "_tie", "_digest", F.desc_nulls_last("_refers"), url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        out, size, number, count, crc, part, mark, whose = None, 0, 0, 0, 0, 0, None, None

        def roll() -> pa.RecordBatch:
            nonlocal out, number
            out.close()
            name = f"part-{part:06d}-{number:05d}.warc.gz"
            files.move(temporary, f"{base}/{name}")
            out, number = None, number + 1
            return pa.RecordBatch.from_pydict({"file": pa.array([name]), "part": pa.array([part], pa.int32()), "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64()), "crc32": pa.array([crc], pa.int64())})

        for b in batches:
            for part, k, u, x, d, tie, r in zip(*(b.column(c).to_pylist() for c in ("_part", key, url, "_payload", "_digest", "_tie", "_refers")), strict=True):
                if x is None:
                    mark, whose = (k, tie, d), r
                    continue
                r = whose if mark == (k, tie, d) else None
                if out is None:
                    temporary, size, count, crc = f"{base}/.tmp-{uuid.uuid4().hex}", 0, 0, 0
                    out = files.open_output_stream(temporary)
                data = record(k, u, x, d, r)
                out.write(data)
                size, count, crc = size + len(data), count + 1, zlib.crc32(data, crc)
                if size >= roll_bytes:
                    yield roll()
        if out is not None:
            yield roll()

    rows.mapInArrow(run, "file string, part int, records long, bytes long, crc32 long").write.mode("overwrite").parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def read(spark: SparkSession, folder: str, key: str = "page_id") -> DataFrame:
    """(key, url, record_type, payload, payload_bytes, payload_digest, refers_to) of the files of the manifest; digests and file checksums are checked."""
    files_ = spark.read.parquet(f"{folder}/manifest")
    n = max(1, files_.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        for b in batches:
            for name, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.open(raw) as f:
                    for head, block in parse(f):
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].partition(":")[2]:
                            raise ValueError(f"damaged record in {name}")
                        kind, payload, digest = head["WARC-Type"], None, head["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"damaged payload in {name}")
                        whose = head.get("X-Refers-To-Key")
                        rows.append((int(head["X-Key"]) if "X-Key" in head else None, head["WARC-Target-URI"], kind, payload, int(head["X-Payload-Length"]), digest, int(whose) if whose else None))
                        size, seen = size + len(block), seen + 1
                        if size > 4 << 20 or len(rows) >= 5000:
                            yield _batch(rows, key)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} of {records} records")
                if rows:
                    yield _batch(rows, key)

    return files_.repartition(n).mapInArrow(run, f"{key} long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[key, "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])


def op8(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS d FROM p),
f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND q.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND q.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""
