"""Sources and sinks of files: size guards before content is read, listings, sidecars, archives, dead letters."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from . import keyed

MOST_TEXT, MOST_ZIP, MOST_ENTRY = 50 << 20, 500 << 20, 50 << 20
IMAGES = ("png", "jpg", "jpeg", "gif", "webp")
SKIPPED = r"(\.metadata\.json|\.(jpg|jpeg|png|gif|webp|mp4|webm|mov|mp3|wav|m4a))$"


def binary(spark: SparkSession, path: str, most: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files up to `most` bytes: the guard is pushed into the listing, larger files are never opened. Spark's own reader: any store, but the driver holds the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files if most is None else files.where(F.col("length") <= most)


def texts(spark: SparkSession, path: str, most: int = MOST_TEXT, pattern: str | None = None) -> DataFrame:
    """(path, text) of UTF-8 files that hold something. They are listed and read in tasks."""
    return keyed.contents(spark, path, most, pattern).select("path", F.col("content").cast("string").alias("text"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files that hold text: no empty files, sidecars, images or media. They are listed in tasks, contents are not read."""
    return keyed.listing(spark, path).where((F.col("length") > 0) & ~F.lower("path").rlike(SKIPPED))


def partial_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_start, page_end, text) of files pages_A-B.txt."""
    files = texts(spark, path, pattern="pages_*.txt")
    number = lambda i: F.regexp_extract("path", r"pages_(\d+)-(\d+)\.txt$", i).try_cast("int")
    return files.select("path", number(1).alias("page_start"), number(2).alias("page_end"), "text").where("page_start is not null")


def uri_parts(uri: Column) -> Column:
    """struct(bucket, key) of s3://bucket/key and https://s3.region.amazonaws.com/bucket/key; null for others."""
    short, long = r"^s3://([^/]+)/?(.*)$", r"^https://s3[.-][^/]*amazonaws\.com/([^/]+)/?(.*)$"
    part = lambda i: F.when(uri.rlike(short), F.regexp_extract(uri, short, i)).when(uri.rlike(long), F.regexp_extract(uri, long, i))
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("bucket"), part(2).alias("key")))


def allowed_uri(uri: Column, bucket: str) -> Column:
    """The uri if it lies in the one bucket that may be read, else null."""
    return F.when(uri_parts(uri)["bucket"] == bucket, uri)


def sidecars(df: DataFrame, uri: str, metadata: str, normalised: bool = True) -> DataFrame:
    """(path, text) of the sidecar files of metadata maps (map<string,string>): values as search terms, or as they are."""
    values = F.transform_values(metadata, lambda k, v: M.expand(v)) if normalised else F.col(metadata)
    kept = F.map_filter(values, lambda k, v: v.isNotNull())
    return df.select(F.concat(F.col(uri), F.lit(".metadata.json")).alias("path"), F.to_json(F.struct(kept.alias("metadataAttributes"))).alias("text"))


def with_sidecars(df: DataFrame, sidecar_files: DataFrame, uri: str) -> DataFrame:
    """df with the attributes (map<string,array<string>>) of its sidecar, null where it is missing or broken."""
    parsed = F.from_json("text", "metadataAttributes map<string,array<string>>")["metadataAttributes"]
    side = sidecar_files.select(F.regexp_replace("path", r"\.metadata\.json$", "").alias(uri), parsed.alias("attributes"))
    return df.join(side, uri, "left")


def write_texts(df: DataFrame, folder: str, key: str, text: str = "text") -> None:
    """Texts as Parquet by key, each write replacing the partitions (keys) that it holds."""
    df.select(key, text).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def images_of_zips(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(archive, name, size, data, caption): the images of archives, captions from captions.json by full or last name.

    Archives and entries above the limits, entries with absolute or upward names and those of resource forks are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column(path).to_pylist(), b.column(content).to_pylist(), strict=True):
                if data is None or len(data) > MOST_ZIP:
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data))
                    captions = json.loads(archive.read("captions.json")) if "captions.json" in archive.namelist() else {}
                except (zipfile.BadZipFile, ValueError):
                    continue
                captions = captions if isinstance(captions, dict) else {}
                for e in archive.infolist():
                    name = e.filename
                    if e.is_dir() or e.file_size > MOST_ENTRY or name.startswith("/") or ".." in name.split("/") or "__MACOSX" in name or name.rsplit(".", 1)[-1].lower() not in IMAGES:
                        continue
                    text = captions.get(name) or captions.get(name.rsplit("/", 1)[-1])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((where, pa.string()), (name, pa.string()), (e.file_size, pa.int64()), (archive.read(e), pa.binary()), (text, pa.string()))], names=["archive", "name", "size", "data", "caption"])

    return files.select(path, content).mapInArrow(run, "archive string, name string, size long, data binary, caption string")


def image_problem(content_type: Column, filename: Column, size: Column, most: int = 10 << 20) -> Column:
    """Why an image is refused, or null."""
    ext = F.lower(F.regexp_extract(filename, "[.]([^.]*)$", 1))
    return F.when(~ext.isin(*IMAGES), "unsupported extension").when(content_type.isNotNull() & ~content_type.rlike("^image/(png|jpe?g|gif|webp)$"), "unsupported type").when(size <= 0, "empty").when(size > most, "too large")


def replayed(dead: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Dead letters to send again, under new deduplication ids, and those that stay: the oldest `most` go first."""
    first = dead.orderBy("sent_at", "message_id").limit(most)  # tasks keep `most` rows each
    again = first.withColumn("dedup_id", F.sha2(F.concat("message_id", F.lit("/replay")), 256))
    return again, dead.join(first.select("message_id"), "message_id", "left_anti")


def changes(log: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Inserts and updates of a change log (op, old, new) for one key in which a field has changed."""
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"new.{f}").eqNullSafe(F.col(f"old.{f}"))
    return log.where(F.col("op").isin("INSERT", "MODIFY") & (F.col("key") == key) & differ)


def finished_jobs(events: DataFrame, detail: str = "detail") -> DataFrame:
    """Workflow results whose input and output are JSON inside JSON: (status, input, output as variants)."""
    d = F.from_json(detail, "status string, input string, output string")
    return events.select(d["status"].alias("status"), F.try_parse_json(d["input"]).alias("input"), F.try_parse_json(d["output"]).alias("output"))
