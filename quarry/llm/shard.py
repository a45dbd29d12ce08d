"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit into memory, by a
seeded hash of the whole record. Pass two puts each bucket into a canonical order, shuffles it by
Fisher-Yates with a seed of its own and writes it. Read behind one another, the
buckets are a random order of the corpus; record i of it goes to shard i mod
`shards` at slot i div `shards`, so that counts of shards differ by one at most.

Buckets are made for the bytes of all columns and for BUCKET_ROWS rows at most. One exchange moves the records, whatever their number. Keys
do not matter to it; records that are equal in all columns and would alone fill an eighth of a bucket are
counted first and dealt over the buckets in turn, so that no bucket outgrows its size. The
bucket counts (one row per bucket) are all that is put in sequence, and the same rows give the same order, however they are dealt over partitions.

Defined results: a null text has no bytes and checksum 0; null keys are a key like any other;
equal rows stand next to each other by chance only, and which of them is which cannot be told; a record is never cut, however long; an empty table gives
no rows; other columns are passed through, but for those named _bucket, _slot, shard and slot, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

SHARDS, BUCKET_BYTES, BUCKET_ROWS, SEED = 16, 32 << 20, 1_000_000, 20_240_501
#: Equal records that are dealt by one task at a time.
DEALT = 10_000


def _plain(df: DataFrame) -> list:
    """All columns in a form that can be hashed."""
    return [F.col(c).cast("string") if "map<" in t else F.col(c) for c, t in df.dtypes]


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """df with _bucket and _slot, bucket by bucket in shuffled order, from a table in the shared folder."""
    df = df.drop("_bucket", "_slot", "shard", "slot")
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(8)).cast("long")
    record = F.xxhash64(F.lit(seed), *_plain(df))
    groups = kept(df.select(record.alias("_h"), size.alias("_size")).groupBy("_h").agg(F.count("*").alias("_n"), F.sum("_size").alias("_size")), "records")
    total, rows = groups.agg(F.sum("_size"), F.sum("_n")).first()
    buckets = int(max(1, -(-(total or 0) // bucket_bytes), -(-(rows or 0) // bucket_rows)))
    spread = df.withColumn("_h", record)
    # equal records that fill an eighth of a bucket: fewer than 16 for each bucket
    hot = groups.where((F.col("_size") > bucket_bytes // 8) | (F.col("_n") > bucket_rows // 8)).where("_n > 1").select("_h")
    if buckets > 1 and hot.take(1):
        hot = kept(hot, "hot")
        many = spread.join(hot, "_h", "left_semi").groupBy(*(c for c, t in spread.dtypes)).count()
        many = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {DEALT}"))).alias("_k")).repartition(buckets, "_h", "_k")
        many = many.select("*", F.explode(F.sequence(F.col("_k") * DEALT, F.least((F.col("_k") + 1) * DEALT, F.col("count")) - 1)).alias("_i"))
        many = many.withColumn("_bucket", F.pmod(F.col("_h") % buckets + F.col("_i"), F.lit(buckets)).cast("int")).drop("count", "_k", "_i")
        rest = spread.join(hot, "_h", "left_anti").withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
        spread = rest.unionByName(many)
    else:
        spread = spread.withColumn("_bucket", F.pmod("_h", F.lit(buckets)).cast("int"))
    spread = spread.withColumn("_slot", F.lit(0).cast("long"))
    scattered = spread.repartitionById(buckets, "_bucket").sortWithinPartitions("_bucket", key, "_h").drop("_h")
    spread = scattered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        number = bucket.column("_bucket")[0].as_py()
        order = np.random.Generator(np.random.PCG64([seed, number])).permutation(bucket.num_rows)  # Fisher-Yates
        at = bucket.schema.get_field_index("_slot")
        for k in range(0, len(order), 2000):
            piece = bucket.take(pa.array(order[k : k + 2000]))
            yield from piece.set_column(at, "_slot", pa.array(np.arange(k, k + piece.num_rows))).combine_chunks().to_batches()

    return kept(scattered.mapInArrow(run, spread.schema), "buckets")


def dealt(table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shuffled table with shard and slot."""
    counts = table.groupBy("_bucket").count()
    before = counts.select("_bucket", (F.sum("count").over(Window.orderBy("_bucket")) - F.col("count")).alias("_before"))
    place = F.col("_before") + F.col("_slot")
    return table.join(F.broadcast(before), "_bucket").withColumn("shard", (place % shards).cast("int")).withColumn("slot", F.floor(place / shards).cast("long")).drop("_before", "_bucket", "_slot")


def write_shards(df: DataFrame, folder: str, shards: int = SHARDS, **how) -> None:
    """Shards as Parquet folders shard=K with rows in slot order; files of a shard follow each other by slot."""
    placed = dealt(shuffled(df, **how), shards)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)


def op3(spark, sf_dir: str) -> DataFrame:
    placed = dealt(shuffled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
