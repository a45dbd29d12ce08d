import pytest

from quarry.operators import flows, rebuild
from quarry.sources import store


@pytest.fixture
def tables(spark):
    rows = [(i, f"file {i}", ("document", "scraped", "other")[i % 3]) for i in range(3, 250)] + [(None, "no id", "document")]
    content = spark.createDataFrame(rows, "document_id long, filename string, type string")
    texts = spark.createDataFrame([(i, f"text of {i} " * (i % 30)) for i in range(3, 250) if i % 7], "document_id long, text string")
    return content, texts


def plain(df):
    return sorted((tuple(r) for r in df.select("batch", "processed_count", "error_count", "last_errors").collect()), key=repr)


def chunks(df):
    return sorted(tuple(r) for r in df.select("document_id", "chunk", "text").collect())


class Killed(Exception):
    pass


def test_killed_and_resumed_run_equals_one_run(spark, tables, tmp_path):
    content, texts = tables
    folder = f"file://{tmp_path}/index"
    index, want = flows.rebuilt(content, texts)
    seen = []

    def kill(wave):
        seen.append(wave)
        if len(seen) in (2, 3):
            raise Killed

    for _ in range(2):
        with pytest.raises(Killed):
            rebuild.run(folder, "one", content, texts, waves=5, after=kill)
        assert rebuild.holder(spark, folder) == "one" and rebuild.current(spark, folder) is None
        with pytest.raises(rebuild.Busy):
            rebuild.run(folder, "two", content, texts)
        with pytest.raises(rebuild.Busy):
            rebuild.guarded(spark, folder)
    # a wave whose chunks were written without its tallies is done anew, and replaces them
    spark.range(3).selectExpr("id as document_id", "0 as chunk", "'half' as text").write.parquet(f"{folder}/one/index/wave=3")
    got = rebuild.run(folder, "one", content, texts, waves=9, after=kill)
    assert seen == [0, 1, 2, 3, 4]  # no wave was done twice
    assert plain(got) == plain(want) and chunks(rebuild.current(spark, folder)) == chunks(index)
    assert rebuild.holder(spark, folder) is None
    rebuild.guarded(spark, folder)


def test_next_run_replaces_the_last_one(spark, tables, tmp_path):
    content, texts = tables
    folder = f"file://{tmp_path}/index"
    rebuild.run(folder, "one", content, texts, waves=2)
    rebuild.run(folder, "two", content.where("document_id < 50"), texts, waves=2)
    assert {r.document_id for r in rebuild.current(spark, folder).collect()} == {i for i in range(3, 50) if i % 7 and i % 3 != 2}
    assert store.listed(spark, folder) == ["current", "two", "two.plan"]
    with pytest.raises(Killed):
        rebuild.run(folder, "bad", content, texts, after=lambda wave: (_ for _ in ()).throw(Killed()))
    rebuild.dropped(spark, folder, "bad")
    assert store.listed(spark, folder) == ["current", "two", "two.plan"]
    assert rebuild.run(folder, "empty", content.limit(0), texts).count() == 0


def test_control_files(spark, tmp_path):
    uri = f"file://{tmp_path}/a/lock"
    assert store.read(spark, uri) is None and not store.exists(spark, uri)
    assert store.created(spark, uri, "é1") and not store.created(spark, uri, "2") and store.read(spark, uri) == "é1"
    store.replaced(spark, uri, "3")
    assert store.read(spark, uri) == "3" and store.listed(spark, f"file://{tmp_path}/a") == ["lock"]
    assert store.removed(spark, uri) and not store.removed(spark, uri)
