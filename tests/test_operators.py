import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.operators import catalog, crawl, keylib, media, progress
from quarry.operators import flows as W
from quarry.operators import retrieval as R
from quarry.operators.filters import compiled, names_only, validated


def holds(expr, row):
    """The filter language, evaluated plainly."""
    out = []
    for key, value in expr.items():
        if key == "$and":
            out.append(all(holds(x, row) for x in value))
        elif key == "$or":
            out.append(any(holds(x, row) for x in value))
        else:
            for op, x in (value if isinstance(value, dict) else {"$eq": value}).items():
                have = row[key] if isinstance(row[key], list) else [] if row[key] is None else [row[key]]
                test = {"$eq": lambda v: v == x, "$listContains": lambda v: v == x, "$in": lambda v: v in x, "$gt": lambda v: v > x, "$gte": lambda v: v >= x, "$lt": lambda v: v < x, "$lte": lambda v: v <= x}
                if op == "$exists":
                    out.append((row[key] is not None) == x)
                elif op in ("$ne", "$nin"):
                    out.append(not any(test["$eq" if op == "$ne" else "$in"](v) for v in have))
                else:
                    out.append(any(test[op](v) for v in have))
    return all(out)


def made(rng, depth=2):
    if depth and rng.random() < 0.5:
        return {rng.choice(["$and", "$or"]): [made(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    key = rng.choice(["a", "n", "tags"])
    values = [1, 2, 3] if key == "n" else ["x", "y", "z"]
    op = rng.choice(["$eq", "$ne", "$in", "$nin", "$exists", "$listContains"] + (["$gt", "$gte", "$lt", "$lte"] if key == "n" else []))
    return {key: {op: rng.sample(values, 2) if op in ("$in", "$nin") else rng.random() < 0.5 if op == "$exists" else rng.choice(values)}}


def test_filters_equal_plain_evaluation(spark):
    rng = random.Random(4)
    rows = [{"i": i, "a": rng.choice(["x", "y", None]), "n": rng.choice([1, 2, 3, None]), "tags": rng.choice([None, [], ["x"], ["y", "z"]])} for i in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "i int, a string, n int, tags array<string>").cache()
    for _ in range(25):
        expr = made(rng)
        assert {r.i for r in df.where(compiled(expr, df.schema)).collect()} == {r["i"] for r in rows if holds(expr, r)}, expr


def test_validation():
    assert validated({"$and": [{"A": "X"}]}) == {"A": {"$eq": "x"}}
    assert validated({"k": {"$bad": 1}, "$or": [], "$eq": 2}) is None
    assert validated({"k": 1, "other": 2}, ["k"]) == {"k": {"$eq": 1}}
    assert validated("no") is None and validated({"k": {"$in": ["A", 1]}}) == {"k": {"$in": ["a", 1]}}
    assert names_only({"$or": [{"a": 1}, {"b": 2}]}, ["a", "b"]) and not names_only({"$not": 1}, ["a"]) and not names_only({}, ["a"])


@pytest.mark.parametrize("f,u,most,want", [(0.72, 0.85, 1.5, 0.85 / 0.72 * 1.05), (0.90, 0.70, 1.5, 1.02), (None, 0.85, 1.5, 1.5), (0.72, None, 1.5, 1.5), (0.0, 0.85, 1.5, 1.5), (0.20, 0.90, 1.5, 1.5), (0.80, 0.80, 1.5, 1.05), (0.8, 0.8, 1.01, 1.01)])
def test_boost(spark, f, u, most, want):
    row = spark.createDataFrame([(f, u)], "f double, u double").select(R.boost(F.col("f"), F.col("u"), most)).first()
    assert row[0] == pytest.approx(want)


def test_search_reads_only_what_it_needs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = R.slices(df, "embedding", [1.0] * 64, 5, compiled({"label": 3}, df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan and "Python" not in plan


def test_dedup_keeps_blank_keys(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 2), ("", 0.4, 3), ("", 0.3, 4), (None, 0.2, 5)], "uri string, score double, pos int")
    assert [r.pos for r in R.best_per_key(df, "uri").collect()] == [1, 3, 4, 5]
    assert (R.results_wanted(None), R.results_wanted("x"), R.results_wanted(0), R.results_wanted("7")) == (25, 5, 5, 7)
    assert R.query_error(" ") and R.query_error(3) and R.query_error("x" * 10_001) and R.query_error("ok") is None


def test_key_library(spark):
    now = datetime(2024, 1, 1)
    empty = spark.createDataFrame([], keylib.LIBRARY)
    lib = keylib.seeded(empty, now)
    assert lib.count() == 7 and keylib.seeded(lib, datetime(2025, 1, 1)).where(F.col("first_seen") != F.lit(now)).isEmpty()
    gone = keylib.deactivated(lib, preserve=["speaker"])
    assert [r.key_name for r in gone.where("status = 'active'").collect()] == ["speaker"]
    assert keylib.stats(gone).first().deprecated_keys == 6
    batch = keylib.observed(spark.createDataFrame([("speaker", "ann", now), ("speaker", "bob", now), ("new", "3", now)], "k string, v string, at timestamp"), "k", "v", "at")
    rows = {r.key_name: r for r in keylib.upserted(lib, batch).collect()}
    assert rows["speaker"].occurrence_count == 2 and rows["speaker"].sample_values == ["ann", "bob"] and rows["new"].data_type == "number" and len(rows) == 8
    assert keylib.suggested_filter("Maps of Ann, 1890", [("speaker", ["ann", "bob"]), ("x", ["map"])]) == {"speaker": {"$eq": "ann"}}
    assert [r.key_name for r in keylib.similar(lib, "Media Type").collect()][0] == "media_type"
    assert keylib.filter_examples(lib)[0]["filter"]


def test_catalogue(spark):
    t = spark.createDataFrame([(1, "a", 1), (None, "n", 5)], "k int, v string, n int")
    s = spark.createDataFrame([(1, None, 2), (2, "b", 3), (None, "m", 1)], "k int, v string, n int")
    assert sorted(map(tuple, catalog.upsert(t, s, ["k"], add=["n"]).collect()), key=str) == sorted([(1, "a", 3), (None, "m", 6), (2, "b", 3)], key=str)
    df = spark.createDataFrame([(1, "PENDING"), (2, "DONE"), (3, None)], "id int, status string")
    assert [r.status for r in catalog.transition(df, "status", ["PENDING"], "CANCELLED").orderBy("id").collect()] == ["CANCELLED", "DONE", None]
    pages = spark.createDataFrame([("u", "1"), ("v", "2"), ("w", "3")], "url string, h string")
    known = spark.createDataFrame([("u", "1"), ("v", "x"), ("w", None)], "url string, h string")
    assert sorted(r.url for r in catalog.changed(pages, known, "url", "h").collect()) == ["v", "w"]


def test_coupled_quota_equals_replay(spark):
    rng = random.Random(2)
    calls = [(i, rng.choice("abcde"), rng.choice("xy")) for i in range(300)]
    used, want = {}, {}
    for i, u, d in calls:
        ok = used.get((u, d), 0) < 20 and used.get(d, 0) < 60
        want[i] = ok
        if ok:
            used[u, d], used[d] = used.get((u, d), 0) + 1, used.get(d, 0) + 1
    df = spark.createDataFrame(calls, "i int, u string, d string")
    assert {r.i: r.admitted for r in progress.coupled_quota(df, "u", "d", ["i"], 20, 60).collect()} == want


def test_segments(spark):
    words = spark.createDataFrame([("m", 0.5, "a", "s1"), ("m", 29.9, "b", "s2"), ("m", 30.0, "c", "s2"), ("m", 95.0, "d", "s1"), ("m", None, "x", "s1")], "m string, t double, w string, s string")
    length = spark.createDataFrame([("m", 95.0), ("silent", 20.0)], "m string, duration double")
    rows = media.segments(words, "m", "t", "w", ["t"], "s", length).orderBy("m", "segment_index").collect()
    assert [(r.m, r.segment_index, r.timestamp_end, r.text, r.word_count, r.speaker) for r in rows] == [("m", 0, 30, "a b", 2, "s1"), ("m", 1, 60, "c", 1, "s2"), ("m", 2, 90, "", 0, None), ("m", 3, 120, "d", 1, "s1"), ("silent", 0, 30, "", 0, None)]


def test_crawl(spark):
    pages = spark.createDataFrame([("http://a.org/x/", '<a href="/y">1</a><a href="z#f">2</a><a href="mailto:q">3</a><a href="HTTP://B.org/">4</a>')], "url string, html string")
    assert [r.dst for r in crawl.link_graph(pages).orderBy("pos").collect()][:2] == ["http://a.org/y", "http://a.org/x/z"]
    one = spark.createDataFrame([("http://127.0.0.1/",), ("http://[::1]/",), ("https://x.org/a",), (None,)], "u string")
    assert [r.r for r in one.select(U.reachable(F.col("u")).alias("r")).collect()] == [False, False, True, None]
    assert spark.createDataFrame([('<div id="__next"></div>',)], "h string").select(crawl.is_scripted(F.col("h"))).first()[0]


def test_links_are_resolved_as_a_browser_does(spark):
    from urllib.parse import urljoin

    base = ["http://h.org/a/b/c.html", "http://h.org/a/b/", "http://h.org"]
    link = ["x.html", "../x", "../../x/y", "./x?k=1", "?x=1", "/r/../s", "//o.org/z", "https://o.org/q", "#f", "../", "../../../../x"]
    rows = [(b, x) for b in base for x in link]
    df = spark.createDataFrame(rows, "b string, x string").select("b", "x", U.absolute(F.col("x"), F.col("b")).alias("r"))
    for r in df.collect():
        want = urljoin(r.b, r.x)
        assert r.r == want or r.r.replace("h.org/?", "h.org?").replace("h.org/#", "h.org#") == want, (r.b, r.x, r.r, want)


def test_only_private_addresses_of_the_new_kind_are_refused(spark):
    urls = {"http://[::1]/x": False, "http://[fd12::1]/": False, "http://[fe80::2]:80/": False, "http://[2606:4700::1111]/": True, "http://[::ffff:10.0.0.1]/": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.reachable(F.col("u")).alias("r"))
    assert {r.u: r.r for r in df.collect()} == urls


def test_scores_are_compiled_without_fallback(spark):
    """No operator of the search falls back to interpreted code because its code is too large."""
    df = spark.createDataFrame([(i, [float(i + j) for j in range(64)]) for i in range(20)], "vec_id long, embedding array<float>")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        out = R.multislice(df, "embedding", [1.0] * 64, 5, F.col("vec_id") > 3).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(out) >= 5


def test_the_oldest_dead_letters_go_first(spark):
    from quarry.sources.files import replayed

    df = spark.createDataFrame([(f"m{k}", 100 - k) for k in range(10)], "message_id string, sent_at int")
    again, rest = replayed(df, 3)
    assert sorted(r.message_id for r in again.collect()) == ["m7", "m8", "m9"] and again.select("dedup_id").distinct().count() == 3
    assert sorted(r.message_id for r in rest.collect()) == [f"m{k}" for k in range(7)] and rest.columns == df.columns


def test_an_address_known_with_several_contents_counts_once(spark):
    from quarry.functions import urls as U

    pages = spark.createDataFrame([(1, "http://a.org/x?p=1", "one", None), (1, "http://a.org/x?p=2", "three", None)], "job_id int, url string, markdown string, error string")
    known = spark.createDataFrame([("http://a.org/x", "one"), ("http://a.org/x", "two"), ("http://a.org/x", "one")], "url string, markdown string")
    known = known.select(U.url_hash(F.col("url")).alias("url_hash"), U.content_hash(F.col("markdown")).alias("content_hash"))
    out, counts = W.page_changes(pages, known)
    assert sorted(r.status for r in out.collect()) == ["COMPLETED", "SKIPPED"]
    assert [tuple(r) for r in counts.collect()] == [(1, 2, 0, 1)]
