"""One file a key, written by a data source and read back by ranges.

The writer puts each row's text under folder/key: beside its place first and then renamed, so that readers see the old or the new file and a task that is
done again changes nothing. There are no folders or parts a key, and no shuffle. listing() finds the files in tasks and writes their names to the shared folder, so
that the driver holds none of them. heads() reads the first bytes of the files, contents() all of them; kinds() looks at the directory of archives besides, at their end.

Defined results: a null text is an empty file; listing() and heads() have empty files, kinds() leaves them out; rows that repeat a key leave one of their texts; keys with empty, upward or hidden parts are refused before
anything is written of their task; folders may be in any store that pyarrow opens; files and folders whose names begin with . or _ are left out, as in Spark's listings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import scratch
from .sniff import HEAD, archive_kind, sniffed
from .store import created, listed, qualified, read, replaced

#: Folders that spread() deals keys over, and tasks that list them.
FOLDERS, LISTERS = 1024, 128
#: Files whose heads, and bytes of contents, that a task holds at a time.
HELD, HELD_BYTES = 1000, 16 << 20


def opened(uri: str):
    """The file system of a uri and the path in it; file:/a is read as file:///a."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if rest.startswith("/") and not rest.startswith("//") else uri)


class Written(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class KeyedWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Written:
        from pyarrow import fs

        files, base = opened(self.folder)
        folders, n = set(), 0
        for row in iterator:
            parts = (row.key or "").split("/")
            if any(p in ("", "..") or p.startswith(".") for p in parts):
                raise ValueError(f"no key: {row.key!r}")
            folder, name = "/".join([base, *parts[:-1]]), parts[-1]
            if folder not in folders:
                files.create_dir(folder, recursive=True)
                folders.add(folder)
            beside, place = f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}"
            with files.open_output_stream(beside) as out:
                out.write((row.text or "").encode())
            try:
                files.move(beside, place)
            except OSError:  # stores that do not rename over a file
                if files.get_file_info(place).type == fs.FileType.File:
                    files.delete_file(place)
                files.move(beside, place)
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "key string, text string"

    def writer(self, schema, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options["path"])


def write_keyed(df: DataFrame, folder: str, key: str, text: str = "text") -> None:
    """A file folder/key with the text of each row; files of other keys stay."""
    df.sparkSession.dataSource.register(KeyedFiles)
    df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).write.format("keyed_files").mode("append").save(folder)


def spread(key: Column, folders: int = FOLDERS) -> Column:
    """The key below one of `folders` folders, by its hash: no folder grows with all keys, and Spark lists many folders in tasks. Rows dealt by folder() have each folder in one task."""
    return F.concat_ws("/", folder(key, folders), key)


def folder(key: Column, folders: int = FOLDERS) -> Column:
    """The name of the folder that spread() puts a key in."""
    return F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(folders))))


class Counted:
    """A file that can seek, and the bytes that were read of it."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def read(self, n: int = -1) -> bytes:
        out = self.file.read() if n is None or n < 0 else self.file.read(n)
        self.bytes_read += len(out)
        return out

    def seek(self, *where) -> int:
        self.file.seek(*where)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length) of the files below path whose names match the pattern (of fnmatch).

    A task lists the first level; its folders are dealt over LISTERS tasks, which list what is below them, one folder at a time. The names are written to the shared folder.
    """
    root = qualified(spark, path)

    def entries(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            files, base = opened(root)
            scheme, names = root.removesuffix(base), ["path", "folder", "length"]
            for b in batches:
                yield pa.RecordBatch.from_arrays(b.filter(pc.invert(b.column("folder"))).columns, names=names)
                todo = [x.removeprefix(scheme) for x in b.filter(b.column("folder")).column("path").to_pylist()]
                while todo:
                    at = files.get_file_info(todo.pop())
                    found = [at] if at.is_file else files.get_file_info(fs.FileSelector(at.path))  # a file that is the path itself
                    found = [x for x in found if not x.base_name.startswith((".", "_")) or x is at]
                    todo += [x.path for x in found if deep and not x.is_file]
                    rows = [x for x in found if fnmatchcase(x.base_name, pattern or "*") or not x.is_file]
                    rows = [x for x in rows if not deep or x.is_file]
                    columns = [pa.array([scheme + x.path for x in rows], pa.string()), pa.array([not x.is_file for x in rows], pa.bool_()), pa.array([x.size for x in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    form, out = "path string, folder boolean, length long", scratch(spark, "names")
    top = spark.range(1, numPartitions=1).select(F.lit(root).alias("path"), F.lit(True).alias("folder"), F.lit(None).cast("long").alias("length")).mapInArrow(entries(False), form)
    top.repartition(LISTERS, "path").mapInArrow(entries(True), form).select("path", "length").write.parquet(out)
    return spark.read.schema("path string, length long").parquet(out)


def heads(spark: SparkSession, path: str, size: int = HEAD, pattern: str | None = None, archives: bool = False) -> DataFrame:
    """(path, length, head, packed, confidence, bytes_read) of the files below path: their first `size` bytes, and with `archives` the type that an archive's directory tells."""
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        scheme = root.removesuffix(base)
        for b in (whole.slice(i, HELD) for whole in batches for i in range(0, whole.num_rows, HELD)):
            rows = []
            for where in b.column("path").to_pylist():
                with files.open_input_file(where.removeprefix(scheme)) as raw:
                    file = Counted(raw)
                    head = file.read(size)
                    kind = archive_kind(file) if archives and head[:4] == b"PK\x03\x04" else None
                    rows.append((head, *(kind or (None, None)), file.bytes_read))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), *columns], names=["path", "length", "head", "packed", "confidence", "bytes_read"])

    return listing(spark, path, pattern).mapInArrow(run, "path string, length long, head binary, packed string, confidence double, bytes_read long")


def contents(spark: SparkSession, path: str, most: int, pattern: str | None = None) -> DataFrame:
    """(path, content) of the files below path that hold something, and `most` bytes at most: larger ones are never opened."""
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        scheme = root.removesuffix(base)
        for b in batches:
            rows, size = [], 0
            for i, where in enumerate(b.column("path").to_pylist(), 1):
                with files.open_input_file(where.removeprefix(scheme)) as file:
                    rows.append((where, file.read()))
                size += len(rows[-1][1])
                if size >= HELD_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], names=["path", "content"])
                    rows, size = [], 0

    return listing(spark, path, pattern).where(F.col("length").between(1, most)).mapInArrow(run, "path string, content binary")


def kinds(spark: SparkSession, path: str, size: int = HEAD, pattern: str | None = None) -> DataFrame:
    """(path, length, file_type, confidence, bytes_read) of the files below path that hold something, of which no more is read than their heads and the directories of archives."""
    rows = heads(spark, path, size, pattern, archives=True).where("length > 0")
    # a head is no whole archive: what is known of it comes from its directory
    plain = sniffed(F.when(F.substring("head", 1, 4) == F.lit(b"PK\x03\x04"), F.lit(b"PK")).otherwise(F.col("head")), F.element_at(F.split("path", "/"), -1))
    rows = rows.withColumn("_s", plain)
    return rows.select("path", "length", F.coalesce("packed", "_s.type").alias("file_type"), F.coalesce("confidence", "_s.confidence").alias("confidence"), "bytes_read")


def stored_examples(spark: SparkSession, folder: str, text: str, stamp: str, name: str = "default") -> str:
    """Examples of filters as folder/name/examples-<stamp>.json, which never changes, and as latest.json, which is replaced in one step. The first one's place."""
    place = f"{folder}/{name}/examples-{stamp}.json"
    if not created(spark, place, text) and read(spark, place) != text:
        raise ValueError(f"{place} is there")
    replaced(spark, f"{folder}/{name}/latest.json", text)
    return place


def examples(spark: SparkSession, folder: str, name: str = "default", stamp: str | None = None) -> str | None:
    """The latest examples, or those of a stamp; None where there are none."""
    return read(spark, f"{folder}/{name}/{f'examples-{stamp}' if stamp else 'latest'}.json")


def stamps(spark: SparkSession, folder: str, name: str = "default") -> list[str]:
    """The stamps under which there are examples, in order."""
    return [x.removeprefix("examples-").removesuffix(".json") for x in listed(spark, f"{folder}/{name}") if x.startswith("examples-")]
