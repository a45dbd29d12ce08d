import gzip
import hashlib
from pathlib import Path

from quarry.llm import warc


def test_round_trip_and_determinism(spark, tmp_path):
    big, big2 = "<p>" + "x" * 200, "<p>é" + "y" * 200
    rows = [(3, "http://a/é ü", big), (1, "http://b", big), (2, None, big2), (4, "http://c", None), (5, "http://d", "short"), (6, "http://e", "short"), (7, "http://f", big2), (8, "http://g", "z" * 300_000), (1, "http://b", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    got = []
    for n, parts in (("one", 1), ("two", 5)):
        folder = "file://" + str(tmp_path / n)
        warc.write(df.repartition(parts), folder, roll_bytes=300, range_bytes=1 << 20)
        got.append({f.name: f.read_bytes() for f in Path(tmp_path / n).glob("*.warc.gz")})
        assert not list(Path(tmp_path / n).glob(".tmp*"))
    assert got[0] == got[1] and len(got[0]) > 2
    assert all(gzip.decompress(x).startswith(b"WARC/1.1") for x in got[0].values())
    back = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, folder).collect())
    first = {big: 1, big2: 2}
    want = []
    for k, _, t in rows:
        data = (t or "").encode()
        who = first.get(t) if len(data) >= 100 and first.get(t, k) != k else None
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if who else "response", who))
    assert back == sorted(want)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, "file://" + str(tmp_path / "w"))
    assert warc.read(spark, "file://" + str(tmp_path / "w")).count() == 0


def test_files_roll_and_follow_very_large_ids_whatever_the_partitions(spark, tmp_path):
    rows = [(2**60 + k, f"http://h/{k}", f"<p>{hashlib.sha256(str(k).encode()).hexdigest() * 20}") for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for n in (2, 9):
        folder = "file://" + str(tmp_path / str(n))
        warc.write(df.orderBy("html").repartition(n), folder, roll_bytes=4000, range_bytes=100_000)
        got.append({f.name: f.read_bytes() for f in Path(tmp_path / str(n)).glob("*.warc.gz")})
    assert got[0] == got[1]
    keys = [int(line[7:]) for name in sorted(got[0]) for line in gzip.decompress(got[0][name]).decode().split("\r\n") if line.startswith("X-Key: ")]
    assert keys == sorted(k for k, _, _ in rows)  # over all files in the order of their names
    by_range = [name[:11] for name in got[0]]
    assert len(set(by_range)) > 3 and len(by_range) > 2 * len(set(by_range))  # each range rolls several files


def test_null_keys_lie_in_several_ranges(spark):
    from pyspark.sql import functions as F

    from quarry.llm.common import range_id

    df = spark.range(3000).select(F.when(F.col("id") >= 2000, F.col("id") * 2**40).alias("key"), F.xxhash64("id").alias("tie")).repartition(3)
    rows = df.withColumn("part", range_id(df, "key", "tie", 8)).collect()
    rows.sort(key=lambda r: (r.key is not None, r.key or 0, r.tie))
    parts = [r.part for r in rows]
    assert parts == sorted(parts) and set(parts) == set(range(8))
    assert max(parts.count(p) for p in set(parts)) < 600


def test_ranges_hang_on_the_bytes_alone(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as page_id", "'u' as url", "repeat(sha2(cast(id as string), 256), 200) as html")
    warc.write(rows, f"file://{tmp_path}/a")
    assert len({r.part for r in spark.read.parquet(f"file://{tmp_path}/a/manifest").collect()}) == 3  # 5.1 MB, 2 MB at least in each
