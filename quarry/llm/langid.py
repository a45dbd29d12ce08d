"""Language identification by cross-parsing entropy.

One suffix automaton is built per language over labelled text. A document is
parsed against each of them into phrases, each phrase being the longest match
that starts where the one before it ended; few phrases mean that the document
looks like the language. The phrase count is normalised by the text's length
and the training text's length (a phrase costs the logarithm of the number of
places it can point to, and POINT_BITS more for a letter the training text lacks), and the language with the smallest cost wins.

The training sample is bounded: at most `train_chars` characters from at most
`train_docs` different texts of each language, chosen by a hash of the text, with equal shares for all of them. Prediction
covers every whole text: long texts are parsed in blocks of BLOCK symbols in lockstep, whose
phrases are joined to those of one parse of the whole text, in all languages at once. All letters of the samples are symbols; transitions lie
in one table of rows laid into one another, three entries a training character at most, whatever the number of letters and languages.

Defined results: null texts and texts without a letter are `und` with score 0;
ties go to the smaller language name; no labelled row at all gives `und`
everywhere; other columns are passed through, but for those with the names of the new ones, which give way.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sliced

TRAIN_CHARS, TRAIN_DOCS, BLOCK, UNKNOWN = 40_000, 400, 1024, "und"
#: Symbols: 0 is never matched, 1 stands for any run of characters other than letters.
OTHER, GAP, LETTERS = 0, 1, 2
#: What a letter that a language's sample lacks costs beside its phrase: the bits of a code point.
POINT_BITS = 21
#: Places a state tries in the table of transitions before that is made larger.
ATTEMPTS = 400


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a symbol string: the transitions of each state; state 0 is the root."""
    to, length, link, last = [{}], [0], [-1], 0
    for c in symbols.tolist():
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


class Transitions:
    """The transitions of all automata in one table of rows laid into one another: that of state s for symbol c stands at base[s] + c, with its owner.

    Each state tries places that a hash gives until all its symbols' places are free; of states that want one place that with the most symbols gets it.
    """

    def __init__(self, owner: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int):
        order = np.argsort(owner, kind="stable")
        owner, symbol, to = owner[order], symbol[order], to[order]
        size = 1 << max(8, int(len(owner) * 1.6).bit_length())
        while not self._laid(owner, symbol, to, states, width, size):
            size *= 2

    def _laid(self, owner: np.ndarray, symbol: np.ndarray, to: np.ndarray, states: int, width: int, size: int) -> bool:
        self.base, self.cells = np.zeros(states, np.int64), np.full(size + width, -1, np.int64)
        rest, count = np.ones(len(owner), bool), np.bincount(owner, minlength=states)
        for attempt in range(ATTEMPTS):
            at = np.flatnonzero(rest)
            if not len(at):
                return True
            o = owner[at]
            start = (mix(o.astype(np.uint64) + np.uint64(attempt * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)
            slot = start + symbol[at]
            free = np.ones(states, bool)
            free[o[self.cells[slot] >= 0]] = False
            want = np.flatnonzero(free[o])
            want = want[np.argsort(count[o[want]], kind="stable")]
            claim = np.full(size + width, -1, np.int64)
            claim[slot[want]] = o[want]  # the last one, with the most symbols, stays
            free[o[want[claim[slot[want]] != o[want]]]] = False
            got = want[free[o[want]]]
            self.base[o[got]] = start[got]
            self.cells[slot[got]] = (o[got] << 32) | to[at[got]]
            rest[at[got]] = False
        return False

    def find(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states to which the transitions lead; -1 where there is none."""
        cell = self.cells.take(self.base.take(states) + symbols)
        return np.where(cell >> 32 == states, cell & 0xFFFFFFFF, -1)


class Model:
    """The automata of all languages; built once per worker from the sample. Every letter of the samples is a symbol of its own."""

    _built: dict = {}

    def __init__(self, samples: dict[str, str], block: int = BLOCK):
        self.languages, self.block = sorted(samples), block
        points = np.unique(np.concatenate([_points(t) for t in samples.values()] or [np.zeros(0, np.uint32)]))
        letters = [int(p) for p in points if chr(p).isalpha()]
        self.lut = np.full(0x110000, GAP, np.int32)
        self.lut[_letter_points()] = OTHER
        self.lut[letters] = np.arange(len(letters)) + LETTERS
        width, self.bits, self.starts, parts, states = len(letters) + LETTERS, [], [], [], 0
        for name in self.languages:
            symbols = self.symbols(samples[name])
            built = automaton(symbols)
            n = np.array([len(to) for to in built])
            parts.append((np.repeat(np.arange(len(n)), n) + states, np.fromiter((c for to in built for c in to), np.int64), np.fromiter((x for to in built for x in to.values()), np.int64) + states))
            self.starts.append(states)
            states += len(built)
            self.bits.append(np.log2(max(2, len(symbols))))
        if parts:
            self.table = Transitions(*(np.concatenate(x) for x in zip(*parts, strict=True)), states, width)
            #: where each symbol leads from the start of each language's automaton: the start itself if nowhere
            start = np.array(self.starts)[:, None]
            root = self.table.find(np.broadcast_to(start, (len(parts), width)), np.arange(width))
            self.root, self.lacks = np.where(root < 0, start, root), root < 0

    @classmethod
    def of(cls, samples: dict[str, str], block: int) -> Model:
        key = (hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest(), block)
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(samples, block)
        return cls._built[key]

    def symbols(self, text: str) -> np.ndarray:
        s = self.lut[_points(text)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[keep]

    def phrases(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each row in each language.

        Blocks of a row are parsed side by side, each as if a phrase began with it. What follows a phrase's start hangs on nothing before it, so the parse of the block
        before is carried on into the next one until both begin a phrase at one place: from there on they are one. Where they do
        not meet within a block, the next block is begun anew from there.
        """
        return self._parsed(rows, self.block)

    def foreign(self, rows: list[np.ndarray]) -> np.ndarray:
        """Symbols of each row that each language's sample lacks."""
        every, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(s) for s in rows])
        return np.stack([np.bincount(row[lacks[every]], minlength=len(rows)) for lacks in self.lacks], 1)

    def _parsed(self, rows: list[np.ndarray], block: int) -> np.ndarray:
        row = np.concatenate([np.full((len(s) + block - 1) // block, i) for i, s in enumerate(rows)] or [np.zeros(0, int)])
        lanes = [s[a : a + block] for s in rows for a in range(0, len(s), block)]
        n, languages = np.array([len(x) for x in lanes], dtype=np.int64), len(self.languages)
        order = np.argsort(-n, kind="stable")
        at = np.empty(len(n), np.int64)
        at[order] = np.arange(len(n))  # where a lane stands in the grid
        steps = int(n.max(initial=0))
        grid, misses = np.zeros((steps, len(lanes)), np.int32), np.zeros((steps, languages, len(lanes)), bool)
        for place, i in enumerate(order):
            grid[: n[i], place] = lanes[i]
        active = np.searchsorted(-n[order], -np.arange(1, steps + 1), side="right")
        state = np.repeat(np.array(self.starts, np.int64)[:, None], len(lanes), 1)
        for t in range(steps):
            a, c = active[t], grid[t, : active[t]]
            to = self.table.find(state[:, :a], c)
            miss = to < 0
            misses[t, :, :a] = miss
            state[:, :a] = np.where(miss, self.root[:, c], to)
        count = misses.sum(0)[:, at]
        first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        count[:, first] += 1
        # lanes that follow another one of their row, with the states in which that one ended
        lane = np.flatnonzero(~first)

        def follow(k: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Lanes lane[j] in languages k once more from states s, until they meet the parse that began with the lane: what that adds to the misses, if they met, and the last states."""
            here, more, met = at[lane[j]], np.zeros(len(j), np.int64), np.zeros(len(j), bool)
            open_ = np.arange(len(j))
            for t in range(steps):
                open_ = open_[n[lane[j[open_]]] > t]
                if not len(open_):
                    break
                c = grid[t, here[open_]]
                to = self.table.find(s[open_], c)
                miss, old = to < 0, misses[t, k[open_], here[open_]]
                s[open_] = np.where(miss, self.root[k[open_], c], to)
                more[open_] += miss.astype(np.int64) - old
                both = miss & (old | (t == 0))
                met[open_[both]] = True
                open_ = open_[~both]
            return more, met, s

        if len(lane):
            k, j = (x.ravel() for x in np.indices((languages, len(lane))))
            more, met, ended = (x.reshape(languages, -1) for x in follow(k, j, state[:, at[lane - 1]].ravel()))
            # a lane behind one that did not meet begins in another state than was taken; each row's first such lane is done at a time
            behind = np.append(False, lane[1:] == lane[:-1] + 1) & ~first[lane - 1]
            done = np.full((languages, len(rows)), -1)
            while True:
                wrong = np.append(np.zeros((languages, 1), bool), ~met[:, :-1], 1) & behind
                k, j = np.nonzero(wrong & (np.arange(len(lane)) > done[:, row[lane]]))
                _, one = np.unique(k * len(rows) + row[lane[j]], return_index=True)
                if not len(one):
                    break
                k, j = k[one], j[one]
                more[k, j], met[k, j], ended[k, j] = follow(k, j, ended[k, j - 1])
                done[k, row[lane[j]]] = j
            count[:, lane] += more
        total = np.stack([np.bincount(row, c, minlength=len(rows)) for c in count], 1).astype(np.int64)
        total[[not len(s) for s in rows]] = 0
        return total


def _points(text: str) -> np.ndarray:
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _letter_points() -> np.ndarray:
    return np.array([p for p in range(0x110000) if chr(p).isalpha()])


def sample(df: DataFrame, text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS, train_docs: int = TRAIN_DOCS) -> dict[str, str]:
    """The bounded training sample: the text smallest by hash in each of train_docs bins per language, up to train_chars characters. Copies count once."""
    rows = df.select(F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("b", F.pmod(F.xxhash64("h"), F.lit(train_docs)))
    least = rows.groupBy("l", "b").agg(F.min("h").alias("h"))  # train_docs rows of each language at most, whatever the input
    top = rows.join(F.broadcast(least), ["l", "b", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, train_chars)).alias("t"))
    parts: dict[str, list[str]] = {}
    for r in top.orderBy("l", "h", "t").toLocalIterator():
        parts.setdefault(r.l, []).append(r.t)
    out: dict[str, str] = {}
    for name, texts in parts.items():
        share, rest = [""] * len(texts), train_chars
        for left, i in zip(range(len(texts), 0, -1), sorted(range(len(texts)), key=lambda i: len(texts[i])), strict=True):
            share[i] = texts[i][: max(1, rest // left)]  # what short texts leave goes to the longer ones
            rest -= len(share[i]) + 1
        out[name] = " ".join(share)[:train_chars]
    return out


def identify(df: DataFrame, samples: dict[str, str], text: str = "text", block: int = BLOCK) -> DataFrame:
    """df with lang_pred, score and cost (bits per symbol of the best language). No shuffle: one pass over the partitions."""
    df = df.drop("lang_pred", "score", "cost")
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cost")).schema
    schema["lang_pred"].nullable = schema["score"].nullable = schema["cost"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for chunk in sliced(batches, text):
            model = model or Model.of(samples, block)
            rows = [model.symbols(t or "") for t in chunk.column(text).to_pylist()]
            n = np.array([len(s) for s in rows])
            letters = np.array([bool((s != GAP).any()) for s in rows])
            if model.languages:
                cost = (model.phrases(rows) * np.array(model.bits) + model.foreign(rows) * POINT_BITS) / np.maximum(n, 1)[:, None]
                best = cost.argmin(1)
                two = np.sort(cost, 1)
                low = two[:, 0]
                score = 1 - low / np.maximum(two[:, 1], 1e-12) if len(model.languages) > 1 else 1 / (1 + low)
                names = np.array(model.languages, dtype=object)[best]
            else:
                low, score, letters, names = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), bool), np.full(len(rows), UNKNOWN, object)
            out = chunk.append_column("lang_pred", pa.array(np.where(letters, names, UNKNOWN), pa.string()))
            out = out.append_column("score", pa.array(np.where(letters, np.clip(score, 0, 1), 0.0)))
            yield from out.append_column("cost", pa.array(np.where(letters, low, 0.0))).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def labelled(documents: DataFrame) -> DataFrame:
    """The rows to learn from: crc32 of the id as text, modulo 3, is not 1."""
    return documents.where("crc32(cast(doc_id as string)) % 3 <> 1 or doc_id is null")


def op1(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = sample(labelled(documents))
    found = identify(documents.select("doc_id", "text"), samples)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cost")
