import zlib
from collections import Counter

from quarry.llm import shard

SF = "/root/testdata/sf0.01"


def test_law_of_rows(spark):
    rows = shard.op3(spark, SF).collect()
    assert len(rows) == 1000 and {r.law for r in rows} == {"rows"}
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all((r.size, r.text_crc32, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), None) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_order_does_not_hang_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = ({(r.doc_id): (r.shard, r.slot) for r in shard.dealt(shard.shuffled(d, bucket_bytes=1 << 18)).collect()} for d in (df.repartition(3), df.repartition(7, "text")))
    assert one == two
    first = [k for k, _ in sorted(one.items(), key=lambda x: (x[1][1], x[1][0]))]
    assert first != sorted(first)


def test_hot_key_and_edges(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 500 + [(None, None)] * 300 + [(i, "") for i in range(200)], "doc_id long, text string")
    table = shard.shuffled(df, bucket_bytes=5000)
    sizes = [r["count"] for r in table.groupBy("_bucket").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 300
    assert shard.dealt(table).count() == 1000
    again = shard.shuffled(df.repartition(9), bucket_bytes=5000)
    assert sorted(map(tuple, table.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert shard.dealt(shard.shuffled(df.limit(0))).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    shard.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 4


def test_rows_without_bytes_other_columns_and_long_texts(spark):
    rows = [(i, None, "y" * (i % 50), i) for i in range(3000)] + [(9999, "long " * 400_000, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _slot string, shard int")
    table = shard.shuffled(df, bucket_bytes=20_000, bucket_rows=500)
    assert table.select("_bucket").distinct().count() > 5 and table.groupBy("_bucket").count().agg({"count": "max"}).first()[0] < 900
    placed = shard.dealt(table)
    assert placed.columns == ["doc_id", "text", "shard", "slot"] and placed.count() == 3001
    assert max(len(r.text or "") for r in placed.collect()) == 2_000_000
    wide = spark.createDataFrame([(i, "t", "y" * 100) for i in range(1000)], "doc_id long, text string, note string")
    assert shard.shuffled(wide, bucket_bytes=20_000).select("_bucket").distinct().count() >= 5
