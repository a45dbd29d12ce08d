import zlib
import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, tokenfile

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n \t x", "it's I'LL we've 'tis 's", "é é ß ΑΣ 　x", "a" * 5000, "12345 6.7", "😀👍🏽 x", "<|endoftext|> and <s>", "x  y   z ", "word " * 30000]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_pack_and_unpack(ranks):
    a = np.array(ranks, np.uint32)
    assert tokenfile.unpack(*tokenfile.pack(a), len(a)).tolist() == ranks


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.union(odd)
    want = {}
    for r in every.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(every, path).collect()}
    assert got == want
    back = bpe.decode(bpe.encode(odd.withColumnRenamed("doc_id", "ids").selectExpr("ids as k", "text", "'x' as ids"), path), path).collect()
    assert {10_000 + i for i in range(len(ODD))} == {r.k for r in back}
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in back)
    assert bpe.round_trip(every.limit(0), path).count() == 0


def test_token_file_equals_the_library(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(-5, "first")], "doc_id long, text string")
    every = docs.union(odd)
    folder = "file://" + str(tmp_path / "t")
    tokenfile.write(every, folder, path, 2)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, folder, digest=True).collect())
    want, at = [], 0
    for r in sorted(every.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    first = tokenfile.read(spark, folder).where("doc_id = -5").first()
    assert first.ids == [*library.encode("first", add_special_tokens=False).ids, 2]


def test_token_file_edges(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string")
    for name, rows, n in (("some", df, 4), ("none", df.limit(0), 0)):
        folder = "file://" + str(tmp_path / name)
        tokenfile.write(rows, folder, path, 2)
        back = tokenfile.read(spark, folder).orderBy("start").collect()
        assert len(back) == n
        if n:
            assert [r.doc_id for r in back] == [None, 1, 1, 2] and back[3].ids == [2]


def test_token_file_keeps_the_order_of_very_large_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART_BYTES", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(8)
    rows = [(int(k), f"text {k} {i}") for i, k in enumerate(rng.permutation(3000) + 2**60)] + [(2**60 + 7, f"again {i}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    folder = "file://" + str(tmp_path / "t")
    tokenfile.write(df, folder, path, 2)
    assert spark.read.parquet(f"{folder}/manifest").count() > 20
    back = tokenfile.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted(k for k, _ in rows)
    assert [r.start for r in back] == np.cumsum([0, *[r.n_tokens for r in back]])[:-1].tolist()
