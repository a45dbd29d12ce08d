"""BPE encoding and decoding over a pair occurrence index.

The pieces (words) of all texts in a chunk of a partition are split off by
character class in numpy and dictionary-encoded, so that each distinct piece
is merged once. All distinct pieces lie behind one another in one linked list
of symbols; an index maps each mergeable pair to all its positions. The active
ranks are taken in ascending order from a heap: all places of the lowest rank
are merged at once and the lists of the pairs to their left and right are
updated. This equals merging one place after the other as long as every token
comes from one merge only, which Vocabulary checks.

Encoding is partition-local (no shuffle); memory is bounded by the chunk and by
WORDS_KEPT remembered pieces per worker.

Defined results: a null or empty text has no tokens; texts of any length are
taken whole; the strings of special tokens in a text become their ids; other
columns are passed through, but for those with the names of the new ones, which give way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

WORDS_KEPT = 400_000
SPACE, LETTER, NUMBER, SIGN = 0, 1, 2, 3
#: White space by the Unicode property, fixed.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a piece of its own, fixed.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, SIGN, np.uint8)
    kinds = [unicodedata.category(chr(p))[0] for p in range(0x110000)]
    out[[k == "L" for k in kinds]] = LETTER
    out[[k == "N" for k in kinds]] = NUMBER
    out[WHITE] = SPACE
    return out


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Pieces:
    """The pieces of many texts: a code per piece into `words` (an Arrow array of distinct pieces), and piece offsets per text."""

    def __init__(self, texts: list[str], spaced: bool):
        """spaced: a piece takes one blank before it and white space is kept (byte-level style); else white space is dropped and numbers stand alone."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            self.words, self.codes, self.offsets = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            return
        ends = np.cumsum(sizes)
        cls = classes()[cp]
        head = np.zeros(n + 1, bool)
        head[0] = True
        head[ends] = True  # the first character of a text
        head = head[:n]
        tail = np.ones(n, bool)  # the last character of a text
        tail[:-1] = head[1:]
        space = cls == SPACE
        before = np.zeros(n, np.uint8)
        before[1:] = cls[:-1]
        change = head.copy()
        change[1:] |= cls[1:] != cls[:-1]
        if spaced:
            blank = np.zeros(n, bool)  # a blank of the same text stands before
            blank[1:] = cp[:-1] == 32
            blank &= ~head
            into = np.zeros(n, bool)  # something other than white space of the same text follows
            into[:-1] = ~space[1:]
            into &= ~tail
            start = np.where(space, change | into, change & ~blank)
        else:
            start = change | (cls == NUMBER)
        self._contract(cp, cls, head, tail, before, start, spaced)
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        byte = np.concatenate([[0], np.cumsum(width)])
        at = np.flatnonzero(start)
        bounds = np.append(byte[at], byte[-1])
        flat = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(joined.encode())])
        coded = flat.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = np.searchsorted(at, np.concatenate([[0], ends]))
        if not spaced:
            keep = ~space[at]
            codes, first = codes[keep], np.concatenate([[0], np.cumsum(keep)])[first]
        self.words, self.codes, self.offsets = words, codes, first

    @staticmethod
    def _contract(cp, cls, head, tail, before, start, spaced: bool) -> None:
        """An apostrophe that begins a piece, and the letters of a contraction after it, are one piece."""
        for p in np.flatnonzero((cp == 39) & start & ~tail):
            if spaced and not head[p] and cp[p - 1] == 32:
                continue
            for c in CONTRACTIONS:
                e = p + 1 + len(c)
                if e <= len(cp) and all(cp[p + 1 + k] == ord(x) for k, x in enumerate(c)) and not head[p + 1 : e].any():
                    start[p + 1 : e] = False
                    if e < len(cp):
                        start[e] |= cls[e] != SPACE or not spaced or head[e]
                        if spaced and not head[e] and cls[e] == SPACE:
                            start[e] = True
                    break


class Vocabulary:
    """A BPE vocabulary of the tokenizers library: ids, merges, normaliser and special tokens."""

    _read: dict = {}

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.end = model.get("end_of_word_suffix") or ""
        kinds = json.dumps(spec.get("normalizer") or {})
        self.normal, self.lower = '"NFC"' in kinds, '"Lowercase"' in kinds
        self.spaced = not self.end
        left, right, out = (np.empty(len(model["merges"]), np.int64) for _ in range(3))
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left[r], right[r], out[r] = self.ids[a], self.ids[b], self.ids[a + b]
        if len(np.unique(out)) < len(out):
            raise ValueError("two merges give the same token; ranks can't be applied list by list")
        self.merged, self.size = out, size
        keys = left * size + right
        self.by = np.argsort(keys, kind="stable")
        self.keys = keys[self.by]
        letters = byte_letters()
        self.first = np.array([self.ids[x] for x in letters])
        self.last = np.array([self.ids[x + self.end] for x in letters])
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._read:
            cls._read.clear()
            cls._read[path] = cls(path)
        return cls._read[path]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; len(merged) where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by[at], len(self.merged)) if len(self.keys) else np.zeros(len(a), np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind one another, and offsets."""
        n = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        total, ends = len(data), np.cumsum(n)
        none = len(self.merged)
        sym = self.first[data] if total else np.zeros(0, np.int64)
        sym[ends[n > 0] - 1] = self.last[data[ends[n > 0] - 1]]
        word = np.repeat(np.arange(len(words)), n)
        # one spare place at the end stands for "no neighbour"
        nxt = np.arange(1, total + 1)
        nxt[ends[n > 0] - 1] = total
        prv = np.arange(-1, total - 1)
        prv[(ends - n)[n > 0]] = total
        nxt, prv, sym = np.append(nxt, total), np.append(prv, total), np.append(sym, -1)
        alive = np.ones(total + 1, bool)
        alive[total] = False
        left = np.flatnonzero(nxt[:total] < total)
        rank = np.full(total + 1, none)
        rank[left] = self.ranks(sym[left], sym[nxt[left]])
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray) -> None:
            """Enter places under the ranks of the pairs that begin there."""
            at = at[rank[at] < none]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            of = rank[at]
            cut = np.flatnonzero(of[1:] != of[:-1]) + 1
            for r, some in zip(of[np.append(0, cut)].tolist(), np.split(at, cut), strict=True):
                if r in places:
                    places[r].append(some)
                else:
                    places[r] = [some]
                    heapq.heappush(heap, r)

        index(left)
        while heap:
            r = heapq.heappop(heap)
            at = places.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            two = nxt[at]
            if sym[at[0]] == sym[two[0]]:  # places of a pair of equal symbols can overlap: the leftmost goes first
                keep, taken = [], -1
                for p, q in zip(at.tolist(), two.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep)
                two = nxt[at]
            sym[at] = self.merged[r]
            alive[two] = False
            rank[two] = none
            after = nxt[two]
            nxt[at] = after
            prv[after] = at
            prv[total] = nxt[total] = total
            back = prv[at]
            back = back[back < total]
            touched = np.concatenate([at, back])
            follow = nxt[touched]
            rank[touched] = np.where(follow < total, self.ranks(sym[touched], sym[follow]), none)
            index(np.unique(touched))
        live = alive[:total]
        return sym[:total][live], np.concatenate([[0], np.cumsum(np.bincount(word[live], minlength=len(words)))]).astype(np.int64)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each distinct word as little-endian 32-bit integers; what is not yet known is merged in one go."""

        def merged(new: list[bytes]) -> list[bytes]:
            ids, off = self.merge(new)
            raw, off = ids.astype("<u4").tobytes(), (4 * off).tolist()
            return [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

        return remembered(self.known, words, merged)

    def prepare(self, text: str) -> str:
        if self.normal and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        return text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another (unsigned 32 bit), and offsets per text."""
        return encode_with(texts, self.special, self.cut, self.prepare, self.spaced, self.words)


def remembered(known: dict[bytes, bytes], words: list[bytes], merged) -> list[bytes]:
    """The ids of each word, of which those not in `known` come from merged() and are kept up to WORDS_KEPT."""
    new = [w for w in words if w not in known]
    if new:
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = words
        known.update(zip(new, merged(new), strict=True))
    return [known[w] for w in words]


def encode_with(texts, special, cut, prepare, spaced, encode_words) -> tuple[np.ndarray, np.ndarray]:
    """The frame of encoding: special tokens, pieces, distinct words, ids."""
    parts, owner, marks = [], [], []  # marks: (part, id of the special token after it)
    for i, t in enumerate(texts):
        t = t or ""
        if "<" in t and cut.search(t):
            at = 0
            for m in cut.finditer(t):
                parts.append(prepare(t[at : m.start()]))
                owner.append(i)
                marks.append((len(parts) - 1, special[m.group()]))
                at = m.end()
            t = t[at:]
        parts.append(prepare(t))
        owner.append(i)
    pieces = Pieces(parts, spaced)
    of = encode_words(pieces.words.to_pylist())
    size = np.array([len(x) for x in of], dtype=np.int64) // 4
    start = np.cumsum(size) - size
    values = np.frombuffer(b"".join(of), "<u4")
    n = size[pieces.codes]
    ends = np.cumsum(n)
    ids = values[np.repeat(start[pieces.codes] - (ends - n), n) + np.arange(n.sum())] if len(n) else values[:0]
    off = np.concatenate([[0], ends])[pieces.offsets]  # per part
    owner = np.array(owner, dtype=np.int64)
    if marks:
        at = np.array([off[p + 1] for p, _ in marks])
        ids = np.insert(ids, at, np.array([x for _, x in marks], np.uint32))
        more = np.zeros(len(off), np.int64)
        for p, _ in marks:
            more[p + 1] += 1
        off = off + np.cumsum(more)
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else owner
    return ids.astype(np.uint32), np.concatenate([[0], off[last + 1]]).astype(np.int64)


class Decoder:
    """Ids to text as the library does for a vocabulary without a decoder: token strings joined by blanks."""

    _made: dict = {}

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = pa.array([s.encode() + b" " for s in vocabulary.strings], pa.large_binary())

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls._made:
            cls._made.clear()
            cls._made[path] = cls(Vocabulary.of(path))
        return cls._made[path]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[memoryview]:
        """UTF-8 of each text."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        bound = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        data = memoryview(taken.buffers()[2] or b"")
        return [data[bound[a] : max(bound[a], bound[b] - 1)] for a, b in zip(off[:-1], off[1:], strict=True)]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids array<int>: the tokens of each whole text."""
    df = df.drop("ids")
    schema = df.select("*", F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in sliced(batches, text):
            ids, off = Vocabulary.of(path).encode(chunk.column(text).to_pylist())
            yield from chunk.append_column("ids", pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null ids give an empty text."""
    df = df.drop(into)
    schema = df.select("*", F.lit("").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x if x is not None else [], np.int64) for x in batch.column(ids).to_pylist()]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = Decoder.of(path).decode(np.concatenate(lists) if lists else np.zeros(0), off)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string())], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 in place of the text: encoded and decoded again in one pass."""
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in sliced(batches, text):
            ids, off = Vocabulary.of(path).encode(chunk.column(text).to_pylist())
            raw = memoryview(np.ascontiguousarray(ids if sys.byteorder == "little" else ids.byteswap())).cast("B")
            first = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
            second = [hashlib.sha256(t).hexdigest() for t in Decoder.of(path).decode(ids, off)]
            out = chunk.drop_columns([text]).append_column("n_tokens", pa.array(np.diff(off))).append_column("ids_sha256", pa.array(first, pa.string())).append_column("decoded_sha256", pa.array(second, pa.string()))
            yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(documents.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
