import random

from pyspark.sql import functions as F

from quarry.operators import media, progress
from quarry.streaming import jobs, state
from quarry.streaming.queue import Queue, object_events


def stream(spark, tmp_path, rows, schema, files=3):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return jobs.files(spark, str(folder), schema, per_batch=1)


def collected(spark, df, tmp_path):
    out = []
    jobs.drained(df, str(tmp_path / "cp"), lambda batch, n: out.extend(map(tuple, batch.collect())))
    return out


def test_barrier_counts_each_message_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", f"a{i}", 10, 0, 4, 40) for i in range(4)] + [("a", "a1", 10, 0, 4, 40), ("b", "b0", 1, 9, 2, 20), ("c", "c0", 10, 0, 2, 20)]
    schema = "document_id string, message_id string, succeeded long, failed long, batches_total long, total_pages long"
    out = collected(spark, jobs.barrier(stream(spark, tmp_path, rows, schema)), tmp_path)
    assert sorted(out) == [("a", 40, 0, "COMPLETE"), ("b", 1, 9, "UNREACHABLE")]


def test_quota_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    rows = [(rng.choice("uvw"), "d", i) for i in range(60)]
    out = collected(spark, jobs.quotas(stream(spark, tmp_path, rows, "user_id string, day string, call_id long", 1), 7), tmp_path)
    batch = progress.quota(spark.createDataFrame(rows, "user_id string, day string, call_id long"), ["user_id", "day"], ["call_id"], 7)
    assert sorted(out) == sorted((r.user_id, r.call_id, r.admitted) for r in batch.collect())


def test_repeated_batch_changes_nothing(spark, tmp_path):
    sink = jobs.Table(spark, str(tmp_path / "t"), "k string, n bigint", ["k"], add=("n",))
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n bigint")
    for number in (0, 1, 1):
        sink.merge(batch, number)
    assert sorted(map(tuple, sink.version(2).collect())) == [("a", 2), ("b", 4)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    sink = jobs.Table(spark, str(tmp_path / "t"), "k long, n bigint", ["k"], add=("n",), buckets=8)
    sink.merge(spark.range(100).selectExpr("id as k", "1 as n"), 0)
    sink.merge(spark.createDataFrame([(7, 5)], "k long, n bigint"), 1)
    sink.merge(spark.createDataFrame([(7, 5), (200, 1)], "k long, n bigint"), 2)
    versions = sorted(p.name for p in (tmp_path / "t").glob("_bucket=*/_version=*"))
    assert versions.count("_version=1") == 8 and versions.count("_version=2") == 1 and versions.count("_version=3") <= 2
    assert {r.k: r.n for r in sink.version(3).collect()} == {i: 11 if i == 7 else 1 for i in range(100)} | {200: 1}
    assert {r.k: r.n for r in sink.version(1).collect()} == dict.fromkeys(range(100), 1)
    assert sink.version(0).count() == 0


def test_files_arrive_as_markdown(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.html").write_text("<html><body><h1>Hi</h1></body></html>")
    out = []
    jobs.drained(jobs.arriving(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda batch, n: out.extend(batch.collect()))
    assert [(r.filename, r.file_type, r.markdown) for r in out] == [("p.html", "html", "# Hi")]


def test_state_is_forgotten_by_event_time_over_batches(spark, tmp_path):
    """Calls that come in order over several batches and in one: the same states expire, a late call is dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    day = 86_400
    times = [(k, i, s + 100 * day) for k, i, s in (("a", 1, 0), ("a", 2, 3600), ("b", 3, day), ("a", 4, 4 * day), ("c", 5, 9 * day), ("c", 6, 9 * day + 60), ("d", 7, 30 * day))]
    folder = tmp_path / "in"
    for i, r in enumerate(times):
        frame = spark.createDataFrame([r], "key string, id long, s long").selectExpr("key", "id", "timestamp_seconds(s) as ts")
        frame.coalesce(1).write.parquet(str(folder / f"{i}"))
    schema = "key string, id long, ts timestamp"
    want = [("a", 0, 2, 1, 3600 + 2 * day), ("a", 4 * day, 1, 1, 6 * day), ("b", day, 1, 1, 3 * day), ("c", 9 * day, 2, 1, 9 * day + 60 + 2 * day)]
    want = [(k, (a + 100 * day) * 1000, n, m, (e + 100 * day) * 1000) for k, a, n, m, e in want]
    for i, per_batch in enumerate((1, 3, 100)):
        out = []
        rows = jobs.files(spark, str(folder / "*"), schema, per_batch=per_batch)
        jobs.drained(state.expiring(rows, 1, 2 * state.DAY), str(tmp_path / f"cp{i}"), lambda batch, n: out.extend(map(tuple, batch.collect())))
        assert sorted(out) == want, per_batch


def test_life_of_jobs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    t = lambda n: f"2024-01-01 00:00:{n:02d}"
    asked = [("x", t(0), 0, "start"), ("x", t(1), 1, "start"), ("x", t(9), 9, "drained"), ("x", t(10), 10, "cancel"), ("y", t(0), 0, "start"), ("y", t(3), 3, "cancel_all"), ("z", t(0), 0, "start"), ("z", t(1), 1, "broken"), ("z", t(2), 2, "cancel_all"), ("w", t(0), 0, "cancel")]
    pages = [("x", t(2), 2, "found"), ("x", t(3), 3, "found"), ("x", t(4), 4, "done"), ("x", t(5), 5, "failed"), ("y", t(2), 2, "found"), ("y", t(4), 4, "done"), ("z", t(3), 3, "found")]
    schema = "job_id string, ts string, id long, kind string"
    frames = []
    for name, rows in (("asked", asked), ("pages", pages)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        frames.append(jobs.files(spark, str(tmp_path / name), schema).withColumn("ts", F.to_timestamp("ts")))
    out = collected(spark, state.lives(*frames, failures=0.5), tmp_path)
    by_job = {}
    for job, _, i, status, total, processed, failed, refused in sorted(out, key=lambda r: (r[0], r[1])):
        by_job.setdefault(job, []).append((i, status, total, processed, failed, refused))
    assert by_job == {
        "x": [(0, "PENDING", 0, 0, 0, 0), (2, "DISCOVERING", 1, 0, 0, 1), (4, "PROCESSING", 2, 1, 0, 1), (9, "COMPLETED_WITH_ERRORS", 2, 1, 1, 1)],
        "y": [(0, "PENDING", 0, 0, 0, 0), (2, "DISCOVERING", 1, 0, 0, 0), (3, "CANCELLED", 1, 0, 0, 0)],
        "z": [(0, "PENDING", 0, 0, 0, 0), (1, "FAILED", 0, 0, 0, 0)],
    }
    all_ = state.for_all(spark.createDataFrame([("me", t(1), 1, "cancel_all")], "owner string, ts string, id long, kind string"), spark.createDataFrame([("x", "me"), ("y", "me"), ("z", "you")], "job_id string, owner string"))
    assert sorted(r.job_id for r in all_.collect()) == ["x", "y"]


def test_queue_sends_failures_again_and_buries_them(spark, tmp_path):
    queue = Queue(spark, f"file://{tmp_path}/q", size=4, batches=2, most=3)
    assert queue.consume(lambda b: b) == 0 and queue.done().count() == 0 and queue.dead().count() == 0
    queue.send(spark.createDataFrame([(f"m{i}", str(i)) for i in range(23)], "message_id string, body string").coalesce(1), "one")
    sizes = []

    def handler(batch):
        sizes.append(batch.count())
        number = F.col("body").cast("int")  # 0, 4, 8...: always fails; 1, 5...: once; 2, 6: no answer at first
        error = F.when(number % 4 == 0, "broken").when((number % 4 == 1) & (F.col("receives") == 0), "once")
        return batch.where(~((number % 4 == 2) & (F.col("receives") == 0))).select("message_id", error.alias("error"))

    taken = queue.consume(handler)
    done, dead = queue.done().collect(), queue.dead().collect()
    assert max(sizes) <= 8 and taken == len(sizes)
    assert {r.message_id: r.receives for r in done} == {f"m{i}": 1 if i % 4 == 3 else 2 for i in range(23) if i % 4}
    assert {(r.message_id, r.receives, r.error) for r in dead} == {(f"m{i}", 3, "broken") for i in range(0, 23, 4)}
    assert queue.consume(handler) == 0  # nothing is handled twice
    queue.send(spark.createDataFrame([("n", "3")], "message_id string, body string"), "two")
    assert queue.consume(handler) == 1 and queue.done().count() == len(done) + 1


def test_words_in_batches_equal_windows_of_all(spark, tmp_path):
    """Words that come late but in time change their window; those later than the watermark do not."""
    words = [("m", i, i * 7 % 200, f"w{i}", ("a", "b", None)[i % 3]) for i in range(40)] + [("n", 100, 3, "x", "b"), ("n", 101, 4, "y", "a"), ("n", 102, 95, "z", None)]
    schema = "media string, id long, start long, word string, speaker string"
    for i in range(4):
        spark.createDataFrame(words[i::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    out = jobs.Transcripts(spark, f"file://{tmp_path}/t")
    out.take(jobs.files(spark, str(tmp_path / "in" / "*"), schema, per_batch=1))
    frame = spark.createDataFrame(words, schema)
    want = media.segments(frame, "media", "start", "word", ["start", "id"], speaker="speaker")
    columns = ["media", "segment_index", "timestamp_start", "timestamp_end", "text", "word_count", "speaker"]
    assert sorted(map(tuple, out.segments().select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
    spark.createDataFrame([("m", 900, 1, "late", None), ("m", 901, 20_000, "far", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "5"))
    out.take(jobs.files(spark, str(tmp_path / "in" / "*"), schema, per_batch=1))
    spark.createDataFrame([("m", 902, 2, "too late", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "6"))
    out.take(jobs.files(spark, str(tmp_path / "in" / "*"), schema, per_batch=1))
    first = out.segments().where("media = 'm' and segment_index = 0").first()
    assert "late" in first.text.split() and "too late" not in first.text


def test_events_of_created_media(spark):
    detail = lambda key, bucket="b": f'{{"bucket": {{"name": "{bucket}"}}, "object": {{"key": "{key}", "size": 3}}}}'
    rows = [detail("content/d1/a.MP4"), detail("content/d2/x/b c.ogg"), detail("content/d3/a.txt"), detail("content/a.mp4"), detail("other/d4/a.mp4"), detail("content/d5/mp4"), detail("content/d6/a.mp3", ""), '{"status": "done"}', "no json", None]
    out = object_events(spark.createDataFrame([(r,) for r in rows], "detail string")).collect()
    assert sorted(map(tuple, out)) == [("d1", "a.MP4", "s3://b/content/d1/a.MP4", "s3://b/content/d1/", "video"), ("d2", "b c.ogg", "s3://b/content/d2/x/b c.ogg", "s3://b/content/d2/", "audio")]
