import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, keyed

from .test_sniff import archive


def test_round_trip_of_many_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/k"
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("a/"), F.col("id") % 10, F.lit("/"), "id", F.lit(".txt")).alias("key"), F.concat(F.lit("text é "), "id").alias("text"))
    keyed.write_keyed(rows, folder, "key")
    found = [x for _, _, names in os.walk(tmp_path / "k") for x in names if not x.endswith(".crc")]
    assert len(found) == n and sum(len(d) for _, d, _ in os.walk(tmp_path / "k")) == 11  # folders are those of the keys
    keyed.write_keyed(rows.where("key like '%7.txt'").withColumn("text", F.lit(None).cast("string")), folder, "key")
    back = files.texts(spark, folder).select(F.regexp_extract("path", r"/(\d+)\.txt$", 1).cast("long").alias("id"), "text")
    assert back.where("text <> concat('text é ', id) or id % 10 = 7").count() == 0 and back.count() == n - n // 10  # listings leave empty files out
    assert all(os.path.getsize(tmp_path / "k" / "a" / "7" / f"{i}.txt") == 0 for i in range(7, n, 10))


@pytest.mark.parametrize("key", ["", "/a", "a//b", "a/../b", ".hidden", "a/.b", None])
def test_no_keys(spark, tmp_path, key):
    with pytest.raises(Exception, match="no key"):
        keyed.write_keyed(spark.createDataFrame([(key, "x")], "key string, text string"), f"file://{tmp_path}/k", "key")
    assert not (tmp_path / "b").exists()


def test_only_heads_and_directories_are_read(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"words " * 500_000)
    (tmp_path / "page.bin").write_bytes(b"<html>" + b"x" * 1_000_000)
    (tmp_path / "small").write_bytes(b"")
    (tmp_path / "book.zip").write_bytes(archive(*(f"f{i}" for i in range(300)), "xl/a.xml", types="spreadsheetml"))
    (tmp_path / "other.zip").write_bytes(archive("a" * 50_000))
    (tmp_path / "cut.docx").write_bytes(archive("word/a")[:-30])
    rows = keyed.heads(spark, str(tmp_path))
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert {os.path.basename(r.path): (len(r.head), r.bytes_read, r.length) for r in rows.collect()}["big.txt"] == (4096, 4096, 3_000_000)
    got = {os.path.basename(r.path): (r.file_type, r.confidence, r.bytes_read) for r in keyed.kinds(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"big.txt": ("txt", 0.7), "page.bin": ("html", 0.85), "book.zip": ("xlsx", 0.95), "other.zip": ("txt", 0.7), "cut.docx": ("docx", 0.6)}
    assert all(v[2] <= 4096 for k, v in got.items() if k in ("big.txt", "page.bin"))


def test_examples_keep_their_stamps_and_a_latest_one(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    assert keyed.examples(spark, folder) is None and keyed.stamps(spark, folder) == []
    for stamp, text in (("20240101", "[1]"), ("20240102", "[2]"), ("20240102", "[2]")):
        assert keyed.stored_examples(spark, folder, text, stamp).endswith(f"default/examples-{stamp}.json")
    with pytest.raises(ValueError):
        keyed.stored_examples(spark, folder, "[3]", "20240101")
    assert keyed.examples(spark, folder) == "[2]" and keyed.examples(spark, folder, stamp="20240101") == "[1]" and keyed.stamps(spark, folder) == ["20240101", "20240102"]


@pytest.mark.parametrize("name", ["listed_texts", "keyed_files", "sidecar_round_trip"])
def test_no_folder_holds_all_files(spark, name, monkeypatch):
    from quarry.plans.catalogue import QUERIES

    seen = []
    write = keyed.write_keyed
    monkeypatch.setattr(keyed, "write_keyed", lambda df, folder, key, text="text": (seen.append(folder), write(df, folder, key, text)))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    folders = [len(names) for _, _, names in os.walk(seen[0].removeprefix("file://")) if names]
    assert len(folders) > 32 and max(folders) < sum(folders) / 4


def odd_documents(spark, tmp_path):
    """A folder of documents of which some have no text or an empty one."""
    rows = [(i, None if i % 9 == 0 else "" if i % 9 == 1 else f"text é {i}", ("de", "fr", "es", None)[i % 4], f"S{i % 5}" if i % 7 else None) for i in range(-40, 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["listed_texts", "keyed_files", "sidecar_round_trip"])
def test_documents_without_a_text_are_rows_as_in_sql(spark, tmp_path, name):
    import duckdb

    from quarry.plans.catalogue import ORACLE_SQL, QUERIES

    folder = odd_documents(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns, key = [c[0] for c in want.description], lambda r: tuple(map(str, r))
    assert sorted(map(key, QUERIES[name](spark, folder).select(*columns).collect())) == sorted(map(key, want.fetchall()))


@pytest.mark.parametrize("name", ["listed_texts", "keyed_files", "sidecar_round_trip"])
def test_the_driver_holds_no_listing(spark, tmp_path, name):
    from quarry.plans.catalogue import QUERIES

    out = QUERIES[name](spark, odd_documents(spark, tmp_path))
    assert "binaryFile" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(out.inputFiles()) <= keyed.LISTERS + 4  # the names as the tasks wrote them, and the documents


def test_listing_of_a_tree(spark, tmp_path):
    for name in ("a/b/c.txt", "a/_b/c.txt", "a/.x", "_SUCCESS", "d e%.txt", "a/n.md"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    (tmp_path / "t" / "none.txt").write_bytes(b"")
    of = lambda path, pattern=None: {(r.path.removeprefix(f"file:{tmp_path}/t/"), r.length) for r in keyed.listing(spark, path, pattern).collect()}
    assert of(f"{tmp_path}/t") == of(f"file://{tmp_path}/t") == {("a/b/c.txt", 9), ("d e%.txt", 8), ("a/n.md", 6), ("none.txt", 0)}
    assert of(f"{tmp_path}/t", "*.txt") == {("a/b/c.txt", 9), ("d e%.txt", 8), ("none.txt", 0)} and of(f"{tmp_path}/t/a/n.md") == {("a/n.md", 6)}
    assert {r.text for r in files.texts(spark, f"{tmp_path}/t").collect()} == {"a/b/c.txt", "d e%.txt", "a/n.md"}
    with pytest.raises(Exception, match="FileNotFound"):
        keyed.listing(spark, f"{tmp_path}/none")
