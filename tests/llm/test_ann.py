import numpy as np

from quarry.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = {}
    for q, y in queries:
        far = sorted((float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = far[:k]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [x for x in rows if x[0] % 100 == 0], 10)
    got: dict = {}
    for r in ann.op4(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    by = {i: np.array(x, float) for i, x in rows}
    for q, found in got.items():
        assert found == sorted(found)
        for s, i in found:
            assert abs(s - float(np.sqrt(((by[i] - by[q]) ** 2).sum()))) < 1e-9


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "a"), (100, [1.0, 0.0], "b"), (1, [0.0, 0.0], "c"), (2, None, "d"), (3, [float("nan"), 1.0], "e"), (4, [1.0, None], "f"), (5, [0.0, 1.0], "g"), (6, [2.0, 0.0], "h"), (7, [1.0], "i"), (6, [2.0, 0.0], "h")]
    df = spark.createDataFrame(rows, schema)
    out = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 100, 0.0), (0, 2, 6, 1.0), (0, 3, 5, 1.414214), (100, 1, 0, 0.0), (100, 2, 6, 1.0), (100, 3, 5, 1.414214)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_many_copies_of_one_vector(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, [float(i), 1.0, 0.5]) for i in range(200)], "vec_id long, embedding array<double>")
    out = ann.search(df, df.where("vec_id = 300")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(i, 0.0) for i in range(10)]


def test_recall_on_clustered_vectors_over_many_blocks(spark):
    """20,000 vectors in dense clusters of very different size: every query of the contract against brute force."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 24))
    of = np.minimum((rng.random(20_000) ** 3 * 300).astype(int), 299)
    x = centres[of] + 0.15 * rng.standard_normal((20_000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 100):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits / 2000 >= 0.9


def test_prefixes_are_ranges_of_the_sorted_codes():
    codes = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000))
    for d in (0, 1, 5, 9, 40, 63):
        low, high = ann.prefix(codes[[10, 500]], d)
        for c, a, b in zip(codes[[10, 500]], low, high):
            assert ((codes >= a) & (codes <= b)).tolist() == (codes >> (63 - d) == c >> (63 - d) if d else codes >= 0).tolist()
