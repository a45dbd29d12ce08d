import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import errata


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """(word, form, root, n, n_near, form_n) over all pairs of words."""
    form, out = {}, []
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if near and counts[best] >= 2 * n else None
        out.append((w, form[w], n, len(near)))
    rows = []
    for w, f, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, f, root, n, k, None if f is None else counts[f]))
    return sorted(rows)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_equals_all_pairs_for_any_ranges(spark, size):
    """Dense vocabularies, words that begin others, long paths without branches, accents and single words."""
    rng = np.random.default_rng(size)
    make = lambda letters, low, high: "".join(rng.choice(list(letters), rng.integers(low, high)))
    words = {make("ab", 1, 9) for _ in range(200)} | {make("abcé÷ÿ", 3, 6) for _ in range(150)} | {"prefix" * 40 + make("xyz", 1, 4) for _ in range(40)} | {"a" * k for k in range(1, 30)} | {"lone"}
    counts = {w: int(rng.integers(1, 40)) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    out = errata.variants(vocabulary, size)
    assert sorted(tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute(counts)


def test_words_of_texts(spark):
    """Counted and altered as by plain code; nulls, repeated rows, long texts and clashing columns."""
    rng = np.random.default_rng(2)
    vocabulary = ["Straße", "ÀÿÉxx", "HELLO", "hello", "World", "x÷y×z", "four", "fivee", "don't stop", "lİne", "naïve"]
    rows = [(int(k), " ".join(rng.choice(vocabulary, 40))) for k in range(150)] + [(7, "hello world hello")] * 5 + [(None, "nulls hello nulls"), (None, "nulls"), (3, None), (4, ""), (5, "z" * 100_000 + " " + "hello\n" * 20_000)]
    counts = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 0 if k is None else zlib.crc32(f"{k}:{run}".encode())
            if k is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame([(k, t, 1, "w", "r") for k, t in rows], "doc_id long, text string, n long, word string, run string").repartition(4)
    assert {r.word: r.n for r in errata.words(df).collect()} == want
    assert errata.words(df.limit(0)).count() == 0
    assert errata.variants(spark.createDataFrame([], "word string, n long")).count() == 0
