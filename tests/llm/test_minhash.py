import itertools
import re

import numpy as np

from quarry.llm import minhash

from .test_jaccard import mutants


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) over all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
            parent[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(sets[i]), least.get(root(i)), k == least.get(root(i))) for i, (k, _) in enumerate(rows)), key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, sid string, n long").repartition(3)
    return sorted((tuple(r) for r in minhash.deduplicated(df, **options).collect()), key=repr)


def test_chains_and_groups_equal_all_pairs(spark):
    """Groups of near copies that hold together by chains only, in buckets whose signatures are compared and in larger ones."""
    rng = np.random.default_rng(5)
    texts = [t for f in range(5) for t in mutants(rng, 30, most=7 + 2 * f, name=f"n{f}w")] + mutants(rng, 150, most=10, name="big")
    rows = [(int(k), texts[i]) for i, k in enumerate(rng.permutation(len(texts)))]
    assert got(spark, rows) == brute(rows)


def test_at_the_threshold(spark):
    """17 of 20 shingles shared are linked, 16 of 19 are not."""
    base = [f"w{i}" for i in range(40)]
    rows = []
    for n, rest in ((19, 3), (18, 3), (20, 0), (60, 11)):
        words = [f"{n}-{i}" for i in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + [f"e{n}{i}" for i in range(rest)]))]
    rows += [(100, " ".join(base)), (101, " ".join(base[::-1]))]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 5003}x{i % 17}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab"), (5, "aB"), (6, "a b"), (7, "b a"), (8, "Ä b c d"), (9, "ä b c d"), (9, "Ä B C D"), (None, None), (None, "lone words of a text"), (None, "p q r s"), (10, "p q r s"), (10, "p q r s"), (11, long), (12, long + " end"), (13, "x" * 300_000), (14, "a\x0bb\x0cc\x1fd")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (850, 75, 75))
    off = np.array([0, 0, 925, 1850, 1850])
    sig = minhash.minima(off, np.concatenate([shared, a, shared, b]), 400)
    assert not sig[[0, 3]].any() and abs((sig[1] == sig[2]).mean() - 0.85) < 0.07
    assert (sig[1] == minhash.minima(np.array([0, 925]), np.concatenate([shared, a]), 400)[0]).all()
