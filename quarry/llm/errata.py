"""Grouping of spelling variants: pairs of words one edit apart from a trie whose light subtrees are merged with one letter skipped or replaced.

In the trie of the words each node's child with most words is heavy, the others are light, and so is the end of a word above other words.
Two words one edit apart part at one node, where at most one goes on along the heavy child, so one can be
brought to the other's side: a light subtree is merged into the heavy one with its first letter replaced by the heavy one or with the heavy one put before
it, into the node itself with its first letter skipped, and with the other light ones with the first letter of both replaced.
Terminals that coincide are pairs. A word is touched once for each light step on its path, log2(words) times at most, and
not once a letter as with deletion neighbourhoods.

Words lie in ranges in their order, so that a range holds whole subtrees but for the nodes on the paths of its first and last word. Of those nodes alone the counts
are added up over all ranges, and each range reads back the heavy letters of its own two paths: nothing is asked for by more rows than there are ranges.
Merges below other nodes stay in the range; those at shared nodes are joins on the merged word. A group of coinciding words
has one word a letter at most.

Defined results: null texts have no words; a word's occurrences in rows with a null key are never altered; rows that repeat a key count each; of near words
with the same number of occurrences the first in the order of code points is the form. Words of any length are taken whole. A table without words gives an empty
table. Only the two named columns are read.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC32, CRC32_SQL, kept

#: Letters of a word, least length and least number of occurrences.
LETTERS, LENGTH, OCCURRENCES = "[a-zÀ-ÿ]+", 5, 3
#: One in so many occurrences, by hash, loses a letter.
ALTERED = 97
#: Words in a range, about.
RANGE = 50_000
PAIR, LOOKUP, MEET = 0, 1, 2


def words(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES, altered: int = ALTERED) -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, with their occurrences; one in `altered` (key, word) has one letter less."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    runs = df.select(F.col(key).cast("string").alias("k"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run")).where(F.length("run") >= length)
    h = F.crc32(F.concat("k", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % altered == 0, short).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def children(sorted_words: list[str], lo: int, hi: int, prefix: str) -> Iterator[tuple[str, int, int]]:
    """(letter, first, end) of the words from lo to hi, all below the prefix, that go on with each letter."""
    d = len(prefix)
    while lo < hi:
        if len(sorted_words[lo]) == d:
            lo += 1
            continue
        letter = sorted_words[lo][d]
        end = bisect_left(sorted_words, prefix + chr(ord(letter) + 1), lo, hi)
        yield letter, lo, end
        lo = end


def borders(group: pd.DataFrame) -> pd.DataFrame:
    """(part, prefix, letter, words): the words of a range below each letter, at the nodes on the paths of its first and last word."""
    some, part = sorted(group["word"]), int(group["part"].iloc[0])
    nodes = {w[:d] for w in (some[0], some[-1]) for d in range(len(w) + 1)}
    rows = []
    for prefix in nodes:
        lo = bisect_left(some, prefix)
        hi = bisect_left(some, prefix + chr(0x10FFFF), lo)
        rows.append((part, prefix, "", 0))  # asked for, whether or not words go on in this range
        rows += [(part, prefix, letter, end - first) for letter, first, end in children(some, lo, hi, prefix)]
    return pd.DataFrame(rows, columns=["part", "prefix", "letter", "words"])


def merged(group: pd.DataFrame, heavy: pd.DataFrame) -> pd.DataFrame:
    """(kind, a, b): pairs found in a range; and from shared nodes words b to look up as a, or to meet others under a."""
    some = sorted(group["word"])
    have, shared, rows = set(some), dict(zip(heavy["prefix"], heavy["letter"], strict=True)), []
    stack = [(0, len(some), 0)] if some else []
    while stack:
        lo, hi, d = stack.pop()
        border = lo == 0 or hi == len(some)
        if not border:  # the whole subtree lies here: on to the node where its words part
            if hi - lo == 1:
                continue
            a, b = some[lo], some[hi - 1]
            while d < len(a) and a[d] == b[d]:
                d += 1
        prefix = some[lo][:d]
        below = list(children(some, lo, hi, prefix))
        top = shared.get(prefix) if border else min(below, key=lambda c: (c[1] - c[2], c[0]))[0]
        stack += [(first, end, d + 1) for _, first, end in below]
        if top is None:
            continue
        light = [c for c in below if c[0] != top]
        found = [(prefix + top, prefix)] if len(some[lo]) == d else []
        for _, first, end in light:
            for w in some[first:end]:
                found += [(prefix + top + w[d + 1 :], w), (prefix + w[d + 1 :], w), (prefix + top + w[d:], w)]
        if border:
            rows += [(LOOKUP, a, w) for a, w in found]
            rows += [(MEET, prefix + "*" + w[d + 1 :], w) for _, first, end in light for w in some[first:end]]
            continue
        rows += [(PAIR, a, w) for a, w in found if a in have]
        if len(light) > 1:
            met: dict[str, list[str]] = {}
            for _, first, end in light:
                for w in some[first:end]:
                    met.setdefault(w[d + 1 :], []).append(w)
            rows += [(PAIR, a, b) for same in met.values() for i, a in enumerate(same) for b in same[:i]]
    return pd.DataFrame(rows, columns=["kind", "a", "b"])


def near(vocabulary: DataFrame, size: int = RANGE) -> DataFrame:
    """(a, b): each pair of words(word, ...) that are one inserted, deleted or replaced code point apart, once, a < b."""
    parts = max(1, -(-vocabulary.count() // size))
    ranged = kept(vocabulary.select("word").repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "ranges")
    edges = kept(ranged.groupBy("part").applyInPandas(borders, "part int, prefix string, letter string, words long"), "borders")
    heavy = edges.where("words > 0").groupBy("prefix", "letter").agg(F.sum("words").alias("n")).groupBy("prefix").agg(F.min_by("letter", F.struct((-F.col("n")).alias("n"), "letter")).alias("letter"))
    asked = edges.select("part", "prefix").distinct().join(heavy, "prefix")
    found = ranged.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(merged, "kind int, a string, b string")
    found = kept(found, "merged")
    looked = found.where(F.col("kind") == LOOKUP).join(vocabulary.select(F.col("word").alias("a")), "a")
    met = found.where(F.col("kind") == MEET).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("same")).where(F.size("same") > 1)
    met = met.select(F.posexplode("same").alias("i", "b"), "same").select(F.explode(F.slice("same", F.lit(1), F.col("i"))).alias("a"), "b")
    every = found.where(F.col("kind") == PAIR).select("a", "b").unionByName(looked.select("a", "b")).unionByName(met)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): where the forms lead in the end. Each round doubles the steps; a form is at least twice as frequent as its word, so there are few."""
    now = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = kept(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.drop("moved")


def variants(vocabulary: DataFrame, size: int = RANGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of vocabulary(word, n)."""
    pairs = kept(near(vocabulary, size), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("m"))
    of = both.join(count, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best"))
    out = vocabulary.join(of, "word", "left").withColumn("form_n", -F.col("best.m"))
    fits = F.col("form_n") >= 2 * F.col("n")
    out = out.select("word", F.when(fits, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n"))
    out = kept(out, "forms")
    return out.join(rooted(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark, sf_dir: str) -> DataFrame:
    vocabulary = kept(words(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words")
    return variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = (
    "WITH RECURSIVE "
    + CRC32_SQL
    + r""", runs AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), hashed AS MATERIALIZED (SELECT doc_id, run, c, """
    + CRC32.format("k")
    + r""" AS h FROM (SELECT doc_id, run, count(*) AS c, CAST(doc_id AS VARCHAR) || ':' || run AS k FROM runs GROUP BY doc_id, run), remainders
), v AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), one AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.l || c.r = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN v ON c.l || c.r = v.word
), pair AS MATERIALIZED (SELECT a, b, n AS m FROM one JOIN v ON b = word
), best AS (SELECT a, count(*) AS n_near, min({'m': -m, 'b': b}) AS best FROM pair GROUP BY a
), f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.b END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN best ON word = a
), chain AS (SELECT word, word AS now, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON c.now = f.word WHERE f.form IS NOT NULL
), last AS (SELECT word, max_by(now, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last ON f.word = last.word
"""
)
