import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid

SF = "/root/testdata/sf0.01"


def naive_phrases(text: str, training: str) -> int:
    """Phrases of longest matches by plain search."""
    count, at = 1, 0
    for i in range(len(text)):
        if text[at : i + 1] not in training:
            count += 1
            at = i if text[i] in training else i + 1
    return count


@pytest.mark.parametrize("seed", range(5))
def test_phrases_equal_plain_search(seed):
    rng = np.random.default_rng(seed)
    make = lambda n: "".join(rng.choice(list("abc "), n)).strip() or "a"
    samples = {"x": make(60), "y": make(60)}
    model = langid.Model(samples, block=(1 << 20, 16, 7, 40, 1)[seed])  # blocks change nothing
    texts = [make(n) for n in (1, 5, 40, 120, 300)] + [samples["x"] * 3, "ab" * 80]
    got = model.phrases([model.symbols(t) for t in texts])
    one_blank = lambda s: " ".join(s.split(" ")) if "  " not in s else " ".join(w for w in s.split(" ") if w)
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == [naive_phrases(one_blank(t), one_blank(samples[k])) for k in ("x", "y")]


def test_held_out_accuracy(spark):
    rows = langid.op1(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(documents, "doc_id")
    n, right = held.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 250 and right / n >= 0.97
    assert rows.where("score < 0 or score > 1 or score is null").isEmpty()
    assert rows.count() == documents.count()


def test_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    samples = langid.sample(train)
    assert set(samples) == {"en", "fr"}
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !!", "a"), (4, "the dog", None), (4, "the dog", None), (5, "le chien " * 20000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, samples).select("doc_id", "lang_pred", "score").collect())
    assert [x[:2] for x in out] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "fr")]
    assert all(x[2] == 0 for x in out[:3]) and out[3] == out[4]
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0), samples).count() == 0
    copies = spark.createDataFrame([("la la la", "fr")] * 50 + [("le chien", "fr")], "text string, lang string")
    assert sorted(langid.sample(copies)["fr"].split()) == ["chien", "la", "la", "la", "le"]


def test_scores_and_winners_equal_a_plain_model(spark):
    samples = {"a": "the cat sat on the mat and the dog ran", "b": "le chat est sur la table et le chien court", "c": "\u732b\u5728\u684c\u5b50\u4e0a \u72d7\u5728\u8dd1"}
    texts = ["the dog sat", "le chien est la", "\u732b\u5728\u8dd1", "zzz", "the chat", "\u72d7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, samples).collect()}
    for i, t in enumerate(texts):
        cost = sorted(((naive_phrases(t, s) * np.log2(len(s)) + 21 * sum(c not in s for c in t)) / len(t), k) for k, s in samples.items())
        assert got[i][0] == cost[0][1] and abs(got[i][1] - (1 - cost[0][0] / cost[1][0])) < 1e-9


def test_large_scripts_are_learned_whole(spark):
    """Two languages of 3,000 letters each, apart but for a few: every letter counts."""
    rng = np.random.default_rng(6)
    han = [chr(0x4E00 + i) for i in range(6000)]
    words = lambda lo, hi, n: " ".join("".join(rng.choice(han[lo:hi], 3)) for _ in range(n))
    samples = {"x": words(0, 3000, 8000), "y": words(2900, 6000, 8000), "z": "plain latin words " * 50}
    rows = [(i, words(0, 2900, 200) if i % 2 else words(3000, 6000, 200)) for i in range(40)] + [(99, "latin words")]
    out = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    assert out == {i: "x" if i % 2 else "y" for i in range(40)} | {99: "z"}
