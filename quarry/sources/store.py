"""Small control files in any store that Spark reaches: created once, read, replaced as a whole. Contents never pass half written."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(path)


def qualified(spark: SparkSession, uri: str) -> str:
    """The uri with its scheme."""
    return _path(spark, uri)[1].toString()


def _renamed(spark: SparkSession, uri: str, text: str, how: str) -> None:
    """Writes the text beside its place and renames it there in one step."""
    fs, path = _path(spark, uri)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    chosen = spark.sparkContext._gateway.new_array(options, 1)
    chosen[0] = options.valueOf(how)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, path, chosen)
    finally:
        fs.delete(beside, False)


def created(spark: SparkSession, uri: str, text: str) -> bool:
    """Writes a file that is not there yet; False if it is: of several writers one succeeds."""
    if exists(spark, uri):
        return False
    try:
        _renamed(spark, uri, text, "NONE")
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def replaced(spark: SparkSession, uri: str, text: str) -> None:
    """Writes a file in place of the one that is there; readers see the old or the new one."""
    _renamed(spark, uri, text, "OVERWRITE")


def read(spark: SparkSession, uri: str) -> str | None:
    """A file's text, or None."""
    fs, path = _path(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _path(spark, uri)
    return fs.exists(path)


def removed(spark: SparkSession, uri: str) -> bool:
    """Removes a file or a folder with all in it; False if there is none."""
    fs, path = _path(spark, uri)
    return fs.delete(path, True)


def listed(spark: SparkSession, uri: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    fs, path = _path(spark, uri)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
