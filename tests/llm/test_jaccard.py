import itertools

import numpy as np

from quarry.llm import jaccard

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, similarity=0.8):
    """(class_id, text_id, n_copies) by key, and the keys linked to each one, over all pairs."""
    copies, nulls = {}, [k for k, t in rows if t is None]
    for k, t in rows:
        if t is not None:
            copies.setdefault(frozenset(shingles(t)) or t, []).append(k)
    sets = list(copies)
    linked, parent = {s: set() for s in sets}, {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if isinstance(a, frozenset) and isinstance(b, frozenset) and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
            linked[a].add(min(copies[b]))
            linked[b].add(min(copies[a]))
            parent[root(a)] = root(b)
    least = {}
    for s in sets:
        least[root(s)] = min(least.get(root(s), min(copies[s])), min(copies[s]))
    classes = {k: (least[root(s)], min(copies[s]), len(copies[s])) for s in sets for k in copies[s]}
    return classes | {k: (k, k, 1) for k in nulls}, {k: linked[s] for s in sets for k in copies[s]} | {k: set() for k in nulls}


def same(got, rows, by=None):
    """Membership equals brute force; the links are true ones, and they alone hold each class together."""
    want, linked = by or brute(rows)
    members = {r.doc_id: r for r in got if r.link_id is None}
    assert {k: (r.class_id, r.text_id, r.n_copies) for k, r in members.items()} == want
    text, parent = dict(rows), {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        if r.link_id is not None:
            assert r.link_id in linked[r.doc_id] and r.text_id == r.doc_id and r.class_id == want[r.link_id][0]
            a, b = shingles(text[r.doc_id]), shingles(text[r.link_id])
            assert abs(r.link_similarity - len(a & b) / len(a | b)) < 1e-9
            parent[root(r.doc_id)] = root(r.link_id)
    for k, r in members.items():
        assert root(r.text_id) == root(r.class_id)
    return want


def test_equals_brute_force(spark):
    same(jaccard.op7(spark, SF).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def mutants(rng, n, length=200, most=8, name="w"):
    """Near copies of one text with up to `most` changed words: some too far from it, and linked to others alone."""
    base, out = [f"{name}{k}" for k in range(length)], []
    for i in range(n):
        words = list(base)
        for k in rng.integers(0, length, rng.integers(0, most)):
            words[int(k)] = f"{name}v{rng.integers(0, 6)}"
        out.append(" ".join(words))
    return out


def test_peeled_blocks_have_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    for most, families in ((4, 1), (9, 1), (9, 3), (14, 2)):
        texts = [t for f in range(families) for t in mutants(rng, 400, most=most, name="w" if f < 2 else "q")]
        off, h = jaccard.shingle_sets(jaccard.pa.array(texts))
        rows = [h[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        links, label, reach = jaccard.peel(rows, 0.8)
        sim = jaccard.products(rows)
        whole = np.arange(len(rows))
        for a, b in jaccard.forest(sim.copy(), 0.8):
            whole[b] = whole[a]
        assert [tuple(np.flatnonzero(label == x)) for x in np.unique(label)] and {frozenset(np.flatnonzero(label == x)) for x in label} == {frozenset(np.flatnonzero(whole == x)) for x in whole}
        assert all(abs(sim[a, b] - x) < 1e-9 and x >= 0.8 - 1e-9 for a, b, x in links)
        for c in np.unique(label[reach < 0]):  # what was no pivot lies within the reach of one
            p = max(np.flatnonzero((label == c) & (reach >= 0)), key=lambda p: reach[p])
            assert (1 - sim[p][(label == c) & (reach < 0)] <= reach[p] + 1e-9).all()


def test_one_hot_group_in_blocks(spark):
    """A bucket over several blocks, with members that only members of other blocks connect, and two families that must stay apart."""
    rng = np.random.default_rng(5)
    rows = list(enumerate(mutants(rng, 260, length=120, most=4) + mutants(rng, 60, length=114, most=3) + mutants(rng, 30, length=120, most=8)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block_sets in (150, 40):
        same(jaccard.join(df, brute=16, block_sets=block_sets).collect(), rows, want)


def test_one_hot_group_and_edges(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):  # near copies that share most shingles
        words = list(base)
        words[int(rng.integers(0, 200))] = f"v{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "a b"), (1005, "A  b"), (1006, "a b c"), (1007, "x " * 50_000)]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows] + [(1006, "a b c", "z")], "doc_id long, text string, class_id string")
    out = jaccard.join(df, brute=16).collect()
    assert [r.n_copies for r in out if r.doc_id == 1006] == [2, 2]
    want = same(jaccard.join(df.distinct(), brute=16).collect(), rows)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns  # other columns pass, whatever their names
    assert sorted(r.doc_id for r in kept.collect()) == sorted({want[k][0] for k, t in rows if t is not None} | {1000, 1001})
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.representatives(df.limit(0)).count() == 0


def test_recall_where_all_buckets_are_split(spark):
    """Pairs at the threshold of which one set holds the other, taken to the last level in every run."""
    n = 1500
    rows = []
    for i in range(n):
        words = [f"w{i}x{k}" for k in range(104)]  # 100 shingles, the copy has the first 80
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:84]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    missed = n - jaccard.join(df, brute=1).where("link_id is not null").count()
    assert missed <= 4  # 1.5 expected at a recall of 0.999


def test_links_between_parts_of_a_class_stay(spark):
    """1-2 and 3-4 are most alike, 2-3 is the only link between them."""
    words = [f"w{k}" for k in range(400)]
    cut = lambda a, b: " ".join(words[a:b])
    rows = [(1, cut(0, 300)), (2, cut(6, 306)), (3, cut(34, 334)), (4, cut(40, 340))]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.81).collect()
    same(out, rows, (brute(rows, 0.81)))
    assert len({r.class_id for r in out}) == 1 and any({r.doc_id, r.link_id} & {1, 2} and {r.doc_id, r.link_id} & {3, 4} for r in out if r.link_id)


def test_texts_without_words_differ_after_many_blanks(spark):
    rows = [(1, " " * 5000), (2, " " * 5001), (3, " " * 5000)]
    out = {r.doc_id: (r.class_id, r.link_id, r.n_copies) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (1, None, 2), 2: (2, None, 1), 3: (1, None, 2)}
    assert jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_no_link_between_different_texts_is_left_out(spark):
    """The number of links equals all pairs, in classes of one block, of many blocks, and of sets of many sizes."""
    rng = np.random.default_rng(11)
    grown = [" ".join(f"g{k}" for k in range(60 + 3 * i)) for i in range(40)]
    rows = list(enumerate(mutants(rng, 12, length=90, most=4, name="s") + mutants(rng, 150, length=120, most=5) + grown))
    rows += [(1000 + k, t) for k, t in rows[:5]]  # copies, which are not expanded
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: len(x) for k, x in brute(rows)[1].items()}
    assert sum(want.values()) > 1000
    for block_sets in (2048, 40):
        got = [r for r in jaccard.join(df, brute=16, block_sets=block_sets).collect() if r.link_id is None]
        assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(rows)
