import time

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import retrieval as R


def vectors(spark, n=400, width=8, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, width))
    rows = [(i, x[i].tolist(), i % 4) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * width, 0), (n + 2, [1.0] * (width - 1), 0), (n + 3, [float("nan")] * width, 0), (None, [1.0] * width, 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)


def test_many_queries_equal_single_ones(spark):
    x, df = vectors(spark)
    queries = R.probes(700, 8)
    assert len(queries) == 7 and R.probes(700, 8) == queries and R.probe_count(0) == 5 and R.probe_count(9999) == 10
    got = {}
    for r in R.search_many(df, "embedding", queries, 9).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id, r.score))
    for q, vector in enumerate(queries):
        score = np.round(x @ np.array(vector) / np.linalg.norm(x, axis=1) / np.linalg.norm(vector), R.DIGITS)
        order = sorted(range(len(x)), key=lambda i: (-score[i], i))[:9]
        assert [(i + 1, v) for i, v in enumerate(order)] == [(a, b) for a, b, _ in sorted(got[q])]
        assert np.allclose([s for _, _, s in sorted(got[q])], score[order])
    assert R.search_many(df.limit(0), "embedding", queries, 9).count() == 0


def test_probed_sample_has_each_uri_once(spark):
    _, df = vectors(spark)
    rows = R.probed(df.withColumn("uri", F.when(F.col("vec_id") % 5 == 0, " ").otherwise(F.concat(F.lit("u"), F.floor(F.col("vec_id") / 3)))), "embedding", R.probes(500, 8), 60).collect()
    assert len(rows) == 60 and len({r.uri for r in rows}) == 60 and not any(r.uri.isspace() for r in rows)
    assert [(r["query"], r["rank"]) for r in rows] == sorted((r["query"], r["rank"]) for r in rows)


def slow(seconds):
    @F.udf("boolean")
    def wait(x):
        time.sleep(seconds)
        return True

    return wait


def test_deadline_skips_late_and_failing_slices(spark, tmp_path):
    x, df = vectors(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))  # one task: a late slice leaves cores for the other
    query, k = x[0].tolist(), 5
    whole = R.multislice(df, "embedding", query, k, F.col("label") == 1)
    there = R.multislice_within(df, "embedding", query, k, F.col("label") == 1, seconds=600.0)
    columns = ["vec_id", "label", "slice", "score", "rank"]
    plain = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    assert plain(there) == plain(whole)
    R.multislice_within(df, "embedding", query, k, F.col("label") == 1, seconds=600.0)
    start = time.monotonic()
    late = R.multislice_within(df, "embedding", query, k, (F.col("label") == 1) & slow(2)("vec_id"), seconds=15.0)
    assert time.monotonic() - start < 40
    assert {r.slice for r in late.collect()} == {"unfiltered"}
    assert [r.vec_id for r in late.orderBy("rank").collect()] == [r.vec_id for r in R.multislice(df, "embedding", query, k).orderBy("rank").collect()]
    fails = R.multislice_within(df, "embedding", query, k, F.raise_error(F.lit("broken")).cast("boolean"), seconds=60.0)
    assert {r.slice for r in fails.collect()} == {"unfiltered"}
    active = spark.sparkContext.statusTracker().getActiveJobsIds()
    end = time.monotonic() + 30
    while active and time.monotonic() < end:  # the late slice's job is cancelled, not left running
        time.sleep(0.2)
        active = spark.sparkContext.statusTracker().getActiveJobsIds()
    assert not active
    none = R.multislice_within(df, "embedding", query, k, F.col("label") == 1, seconds=0.0)
    assert none.count() == 0 or {r.slice for r in none.collect()} <= {"filtered", "unfiltered"}
