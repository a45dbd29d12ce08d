"""Shared helpers: Arrow batches, word and shingle hashes, shared folders and range ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle and the similarity from which documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 2 << 20
#: Rows that are sampled for the bounds of ranges, about, for up to a quarter as many ranges.
RANGE_SAMPLE = 2_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INNER = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, removed when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of kept() whose last reader has been written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes of text, cut from or gathered over the batches of a partition."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(n):
            end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]) + size, limit, side="right")))
            held.append(batch.slice(at, end - at))
            size += int(n[at:end].sum())
            at = end
            if size >= limit or at < len(n):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of x for each seed, independent of the machine."""
    return mix(x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))


def word_bytes(texts: pa.Array | pa.ChunkedArray, lower: str = "utf8_lower") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case UTF-8 bytes of all rows, the first and the last-plus-one byte of each word, and word offsets per row.

    Words are the runs between ASCII white space. Null: no words. `lower` is the Arrow function that folds case.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = getattr(pc, lower)(pc.fill_null(texts, ""))
    ends = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4).astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inner = _INNER[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    edge = ends[1:-1][ends[1:-1] < len(data)]
    first[edge] = inner[edge]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    edge = ends[1:-1][ends[1:-1] > 0] - 1
    last[edge] = inner[edge]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, stops, np.searchsorted(starts, ends)


def word_hashes(texts: pa.Array | pa.ChunkedArray, lower: str = "utf8_lower") -> tuple[np.ndarray, np.ndarray]:
    """Word offsets per row and one 64-bit polynomial hash per word of word_bytes()."""
    data, starts, stops, off = word_bytes(texts, lower)
    if not len(starts):
        return off, np.zeros(0, np.uint64)
    n = stops - starts
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at_byte = np.repeat(starts, n) + at
    terms = _BYTES[data[at_byte]] * _POWERS[at & 4095] + (at >> 12).astype(np.uint64)
    return off, mix(np.add.reduceat(terms, np.cumsum(n) - n) ^ (n.astype(np.uint64) << np.uint64(48)))


def shingle_hashes(off: np.ndarray, words: np.ndarray, width: int = SHINGLE, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per row and one hash per run of `width` words. Rows with fewer words have one shingle of all of them, or none if not short."""
    n = np.diff(off)
    count = np.maximum(n - width + 1, 0)
    few = (n > 0) & (n < width) if short else np.zeros(len(n), bool)
    out_off = np.concatenate([[0], np.cumsum(np.where(few, 1, count))])
    out = np.empty(out_off[-1], np.uint64)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled = (rolled + words[k : len(words) - width + 1 + k]) * _MULT
            rolled ^= rolled >> np.uint64(29)
        rows = np.repeat(np.arange(len(n)), count)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        out[out_off[:-1][rows] + inner] = mix(rolled[off[:-1][rows] + inner])
    for i in np.flatnonzero(few):
        x = np.uint64(n[i])
        for w in words[off[i] : off[i + 1]]:
            x = mix(np.array([x ^ w]) * _MULT)[0]
        out[out_off[i]] = x
    return out_off, out


def range_id(df: DataFrame, key: str, tie: str, parts: int) -> Column:
    """An id from 0 to parts - 1 that rises with (integer key, 64-bit tie), nulls first and among themselves by tie; the same for the same rows, however they are dealt over partitions.

    The bounds are quantiles of a sample that a hash of key and tie chooses (equal rows count once and by their number): about 64 rows a part,
    fewer beyond RANGE_SAMPLE rows in all. They are looked up by bisection in whole integers.
    """
    n = df.count() if parts > 1 else 0
    each = max(4, min(64, RANGE_SAMPLE // parts))
    some = df.where(F.pmod(F.xxhash64(F.lit(17), key, tie), F.lit(max(1, n // (parts * each)))) == 0) if n else df.limit(0)
    none = F.col(key).isNull().alias("none")
    rows = some.groupBy(none, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.coalesce(F.col(tie), F.lit(0)).alias("t")).count().toPandas()
    if not len(rows):
        return F.lit(0)
    rows = rows.sort_values(["none", "k", "t"], ascending=[False, True, True])
    upto = rows["count"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts, side="right"))
    bounds = rows.iloc[at[at < len(rows)]]
    nulls = bounds["t"][bounds["none"]].to_numpy(np.int64)
    keys, ties = (bounds[c][~bounds["none"]].to_numpy(np.int64) for c in ("k", "t"))

    @F.pandas_udf("int")
    def place(is_null: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        none, k, t = is_null.to_numpy(bool), k.to_numpy(np.int64), t.to_numpy(np.int64)
        out, upto = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
        for i in np.flatnonzero(upto > out):  # few: the key is a bound itself
            out[i] += np.searchsorted(ties[out[i] : upto[i]], t[i], side="right")
        return pd.Series(np.where(none, np.searchsorted(nulls, t, side="right"), out + len(nulls)).astype(np.int32))

    return place(F.col(key).isNull(), F.coalesce(F.col(key).cast("long"), F.lit(0)), F.coalesce(F.col(tie), F.lit(0)))


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a column over all rows."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


#: For the SQL of queries: crc32 of a text, byte by byte, over a table of 256 remainders.
CRC32_SQL = """remainders AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab)"""
CRC32 = "xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c // 256, tab[1 + xor(c % 256, x)])))"
