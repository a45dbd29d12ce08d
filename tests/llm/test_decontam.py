import numpy as np
import pytest

from quarry.llm import decontam


def greedy(text: list, item: list, least: int) -> int:
    """Covered words by the plain form of greedy string tiling."""
    marked_text, marked_item, covered = [False] * len(text), [False] * len(item), 0
    while True:
        best = []
        longest = least
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not marked_text[i + k] and not marked_item[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j)], k
                elif k == longest:
                    best.append((i, j))
        if not best:
            return covered
        for i, j in best:
            if not any(marked_text[i : i + longest]) and not any(marked_item[j : j + longest]):
                marked_text[i : i + longest] = marked_item[j : j + longest] = [True] * longest
                covered += longest


@pytest.mark.parametrize("seed", range(30))
def test_tiles_equal_plain_tiling(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    item = list(rng.choice(words, 24))
    text = list(rng.choice(words, 10)) + item[12:] + list(rng.choice(words, 5)) + item[:12] + list(rng.choice(words, 6))
    from quarry.llm.common import word_hashes

    found = decontam.Items([1], [" ".join(item)], 3).find(*word_hashes([" ".join(text)] and __import__("pyarrow").array([" ".join(text)])), 0.0)[0]
    assert found[0]["covered"] == greedy(text, item, 3)
    for t in found[0]["tiles"]:
        assert text[t["start"] : t["start"] + t["length"]] == item[t["item_start"] : t["item_start"] + t["length"]]


def test_reordered_passages_and_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    mixed = "x y seven eight nine ten eleven twelve z one two three four five six q"
    rows = [(1, item.upper(), "a"), (2, mixed, "a"), (3, "one two three four five only", "a"), (4, None, "a"), (5, "", "a"), (6, mixed + " word" * 60000, "a"), (6, mixed + " word" * 60000, "a"), (7, "wholly other text", "a"), (8, "tiny item", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tiles string")
    bench = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (13, "tiny item")], "item_id long, text string")
    out = {r.doc_id: [(t.item_id, t.covered) for t in r.tiles] for r in decontam.tiled(docs, bench).collect()}
    both = [(10, 12), (10, 12)]
    assert out == {1: both, 2: both, 3: [], 4: [], 5: [], 6: both, 7: [], 8: [(13, 2)]}
    assert all(not r.tiles for r in decontam.tiled(docs, bench.limit(0)).collect())
    assert decontam.tiled(docs.limit(0), bench).count() == 0


def test_repeated_words_and_many_blocks(spark):
    """A text and an item of one word, and items over many blocks, each found wherever it lies."""
    rng = np.random.default_rng(12)
    items = [(i, " ".join(f"w{rng.integers(0, 10**6)}" for _ in range(60))) for i in range(60)] + [(100, "x " * 200), (101, None)]
    docs = [(i, f"before {items[i][1]} after") for i in range(60)] + [(200, "x " * 200_000), (201, None), (202, "")]
    df = spark.createDataFrame([(k, t, "z") for k, t in docs], "doc_id long, text string, tiles string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: [(x.item_id, x.covered) for x in r.tiles] for r in decontam.tiled(df, bench, block_bytes=2000).collect()}
    assert out == {i: [(i, 60)] for i in range(60)} | {200: [(100, 200)], 201: [], 202: []}
