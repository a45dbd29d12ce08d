"""Near copies by min-hashes: minima of many universal hashes, banding, verified signatures, exact confirmation, connected components.

A text is the set of its three-word shingles. A hash of the family x -> (a x + b) mod 2**64 gives each set a minimum; two sets agree in one with a
probability of about their Jaccard similarity. ROWS minima make a band, and sets that agree in one of BANDS bands meet in a bucket:
a pair at the similarity of 0.85 is missed with a probability of 8e-7. Sets that are alike are one set from here on (copies
never meet in a bucket), and of buckets with the same sets one is looked at.

Signatures are verified in each bucket of up to VERIFIED sets: a set stays with those whose signature agrees
in about as many minima as linked sets have (five standard deviations less: 3e-7 of the links fail), and leaves a bucket where there are none. Larger buckets are groups of
near copies almost always, and are taken on whole. Links are confirmed on the full sets of shingles, by pivots in blocks and not by all pairs, as in jaccard.links():
no link that would connect two texts is lost. Components come from alternating large-star and small-star steps.

Defined results: A-Z are lower-cased, no other letter; words lie between ASCII white space; a text of fewer than three words is one shingle of all of
them; null texts and texts without words have no shingles and are linked with nothing; texts with one set are linked, whatever their order. component_id is
the smallest key of the component (null if all its keys are null), kept says that it is the row's own; rows that repeat a key are rows of their own. An empty table gives
an empty table. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix, sliced
from .components import components
from .jaccard import links, needed, set_ids, shingle_sets, text_hash, unique

WIDTH, SIMILARITY, BANDS, ROWS = 3, 0.85, 24, 5
#: Sets up to which the signatures of a bucket are compared; shingles that are hashed at a time.
VERIFIED, STEP = 64, 16384
LOWER = "ascii_lower"


def family(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of k hash functions."""
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:k] | np.uint64(1), seeds[k:]


def minima(off: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): the upper halves of the minima of each row's hashes; rows without any are zero."""
    n, out = np.diff(off), np.zeros((len(off) - 1, k), np.uint32)
    rows = np.flatnonzero(n)
    factors, summands = family(k)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(off[rows + 1], off[rows[at]] + STEP, side="right")))
        some = rows[at:end]
        x = h[off[some[0]] : off[some[-1] + 1]]
        starts, y = off[some] - off[some[0]], np.empty_like(x)
        for i in range(k):
            np.multiply(x, factors[i], out=y)
            y += summands[i]
            out[some, i] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        at = end
    return out


def signed(df: DataFrame, key: str, text: str, width: int, k: int) -> DataFrame:
    """(key, t, sid, n, sig): the hash of the text, the id (null without shingles) and size of its set, and its k minima of four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in sliced(batches, text):
            off, h = shingle_sets(chunk.column(text), width, LOWER)
            n = np.diff(off)
            ids = [x if size else None for x, size in zip(set_ids(off, h, chunk.column(text).to_pylist()), n, strict=True)]
            raw = minima(off, h, k).astype("<u4").tobytes()
            sig = [raw[4 * k * i : 4 * k * (i + 1)] if size else None for i, size in enumerate(n)]
            yield from pa.table({key: chunk.column(key), "t": chunk.column("t"), "sid": pa.array(ids, pa.binary()), "n": pa.array(n), "sig": pa.array(sig, pa.binary())}).combine_chunks().to_batches()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, text_hash(text).alias("t")).mapInArrow(run, f"{key} {kind}, t string, sid binary, n long, sig binary")


def banded(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(path, s, m, total): the buckets with two sets at least over sets(sid, n, sig), each only once."""
    path = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * rows) + 1, F.lit(4 * rows))))
    node = sets.select(F.col("sid").alias("s"), "n", F.explode(path).alias("path"))
    # counts are written, so that the join reads two plain exchanges and a path with very many sets can be split
    many = kept(node.groupBy("path").count().where("count > 1").select("path"), "counts")
    return unique(kept(node.join(many, "path"), "paths"))


def agreeing(similarity: float, k: int) -> int:
    """Minima in which the signatures of a linked pair agree at least, but for 3e-7 of the pairs."""
    return max(1, math.floor(k * similarity - 5 * math.sqrt(k * similarity * (1 - similarity))))


def verified(buckets: DataFrame, sets: DataFrame, similarity: float, k: int) -> DataFrame:
    """The buckets cut into groups whose signatures agree; sets that agree with no other leave."""
    least = agreeing(similarity, k)

    def groups(rows: list[tuple]) -> Iterator[tuple]:
        sig = np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(len(rows), k)
        near = np.array([(sig == one).sum(1) >= least for one in sig])
        label = np.arange(len(rows))
        while (new := np.where(near, label, len(rows)).min(1)).tolist() != label.tolist():
            label = new
        for r, at in zip(rows, label, strict=True):
            yield r[0], int(at), r[1], r[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "c", "s", "n"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("path", "s", "sig", "n")), strict=True):
                if held and held[-1][0] != r[0]:
                    out += groups(held)
                    held = []
                held.append(r)
            if len(out) > 5000:
                yield batch()
                out = []
        if held:
            out += groups(held)
        if out:
            yield batch()

    small = buckets.where(F.col("m") <= VERIFIED).select("path", "s").join(sets.select(F.col("sid").alias("s"), "n", "sig"), "s")
    split = kept(small.repartition("path").sortWithinPartitions("path", "s").mapInArrow(run, "bucket long, c int, s binary, n long").withColumn("path", F.xxhash64("bucket", "c")), "split")
    some = split.groupBy("path").count().where("count > 1").select("path")
    large = buckets.where(F.col("m") > VERIFIED).select("path", "s", "m", "total")
    return unique(split.join(some, "path").select("path", "s", "n")).unionByName(large)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row of df."""
    k = bands * rows
    marked = kept(signed(df, key, text, width, k), "signed")
    sets = marked.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col(key).alias("k"), "t")).alias("one"), F.min(key).alias("k"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = kept(sets, "sets")
    buckets = kept(verified(banded(sets, bands, rows), sets, similarity, k), "verified")
    edges = kept(links(buckets, needed(df, key, text, sets, buckets), text, width, similarity, lower=LOWER).select(F.col("s").alias("u"), F.col("other").alias("v")), "links")
    of_set = sets.select("sid", "k").join(components(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of_set = kept(of_set, "roots")
    least = kept(of_set.groupBy("root").agg(F.min("k").alias("component_id")), "least")
    own = of_set.join(least, "root").select("sid", "component_id")
    out = marked.select(key, "sid", F.col("n").alias("n_shingles")).join(own, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op12(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), pair AS (SELECT u, v FROM shared JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS MATERIALIZED (SELECT u, v FROM pair UNION SELECT v, u FROM pair
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM reach r JOIN edge e ON r.b = e.u
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = least.a LEFT JOIN n ON d.doc_id = n.doc_id
"""
