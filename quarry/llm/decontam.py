"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of MIN_MATCH words that a text shares with a test item, found by rolling
hashes. For each text and item with a common seed, the places where a maximal match begins are listed and grown along
their diagonals, and the longest match that touches no marked word is marked again
and again, in the text and in the item (a match that is partly covered is cut
to its free runs). The marked words of the item, in whatever order they stand
in the text, over all its words are its coverage; from `coverage` on the text
is contaminated.

Texts stay where they are: one pass, no shuffle. The test items are dealt by hash into
blocks of BLOCK_BYTES in the shared folder, which tasks read from there; nothing of them goes through the driver, and a worker
holds BLOCKS_HELD blocks at a time.

Defined results: words are lower-case runs between white space; an item with fewer than MIN_MATCH
words must occur as a whole; items and texts that are null or have no word
match nothing; repeated items are reported each; of equally long matches the first in the text and then in the item is marked; other
columns are passed through, but for one with the name of the new one, which gives way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, shared_dir, shingle_hashes, sliced, total_bytes, word_hashes

MIN_MATCH, COVERAGE, BLOCK_BYTES, FILTER = 5, 0.6, 8 << 20, 22
#: Blocks of test items that a worker holds, and bytes of text for which it reads them again if there are more: the text and its word hashes are held for that long.
BLOCKS_HELD, PASS_BYTES = 4, 64 << 20
TILES = "array<struct<item_id:bigint,words:int,covered:int,coverage:double,tiles:array<struct<start:int,item_start:int,length:int>>>>"


def matches(text: np.ndarray, item: np.ndarray, before_text: np.ndarray, before_item: np.ndarray, at_text: np.ndarray, at_item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal matches begin (places in text and item): equal seeds that do not follow equal seeds.

    text and item number the seeds at the places at_text and at_item, before_* are the hashes of the seeds before them (0: none). Seeds on one
    diagonal are never listed, so a repeated word costs a row for each diagonal, not for each pair of places.
    """
    order, here = np.argsort(text, kind="stable"), np.argsort(item, kind="stable")
    text, before_text, at_text = text[order], before_text[order], at_text[order]
    item, before_item, at_item = item[here], before_item[here], at_item[here]
    p, q = [], []
    for u in np.unique(item):
        a, b = np.searchsorted(text, [u, u + 1])
        c, d = np.searchsorted(item, [u, u + 1])
        for before in np.unique(before_item[c:d]):
            mine = at_item[c:d][before_item[c:d] == before]
            other = at_text[a:b][(before_text[a:b] != before) | (before == 0)]
            p.append(np.repeat(other, len(mine)))
            q.append(np.tile(mine, len(other)))
    return np.concatenate(p), np.concatenate(q)


def grown(p: np.ndarray, q: np.ndarray, text: np.ndarray, item: np.ndarray, width: int) -> np.ndarray:
    """Words of the matches that begin at p and q; text and item hold the seed hash of each place."""
    length, open_ = np.ones(len(p), np.int64), np.arange(len(p))
    while len(open_):
        x, y = p[open_] + length[open_], q[open_] + length[open_]
        open_ = open_[(x < len(text)) & (y < len(item))]
        open_ = open_[text[p[open_] + length[open_]] == item[q[open_] + length[open_]]]
        length[open_] += 1
    return length + width - 1


def tile(p: np.ndarray, q: np.ndarray, length: np.ndarray, width: int, n: int, m: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the text, start in the item, length) from maximal matches; of equal ones the first in the text, then in the item."""
    heap = list(zip((-length).tolist(), p.tolist(), q.tolist(), strict=True))
    heapq.heapify(heap)
    text, item, out = np.zeros(n, bool), np.zeros(m, bool), []
    while heap:
        k, a, b = heapq.heappop(heap)
        taken = text[a : a - k] | item[b : b - k]
        if not taken.any():
            text[a : a - k] = item[b : b - k] = True
            out.append((a, b, -k))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # the free runs
            if y - x >= width:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return sorted(out)


class Items:
    """A block of test items: word counts, and per seed width the sorted seed hashes with their item and place."""

    _read: dict = {}

    def __init__(self, ids: list, texts: list, min_match: int):
        off, words = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.n = ids, np.diff(off)
        self.seeds = {}
        for width in sorted({int(w) for w in np.minimum(self.n, min_match)} - {0}):
            o, h = shingle_hashes(off, words, width, short=False)
            owner = np.repeat(np.arange(len(ids)), np.diff(o))
            at = np.arange(len(h)) - o[:-1][owner]
            mine = np.minimum(self.n, min_match)[owner] == width
            order = np.flatnonzero(mine)[np.argsort(h[mine], kind="stable")]
            known = np.zeros(1 << FILTER, bool)
            known[h[order] >> np.uint64(64 - FILTER)] = True
            self.seeds[width] = (h[order], owner[order], at[order], known, o, h)

    @classmethod
    def of(cls, folder: str, number: int, min_match: int) -> Items:
        """A block from the shared folder; a worker holds BLOCKS_HELD of them."""
        key = (folder, number, min_match)
        if key not in cls._read:
            while len(cls._read) >= BLOCKS_HELD:
                cls._read.pop(next(iter(cls._read)))
            from pyarrow import fs
            from pyarrow import parquet as pq

            files, base = fs.FileSystem.from_uri(folder)
            path = f"{base}/block={number}"
            there = files.get_file_info(path).type == fs.FileType.Directory
            rows = [r for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")) for r in pq.read_table(files.open_input_file(f)).to_pylist()] if there else []
            rows.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["text"]))
            cls._read[key] = cls([r["id"] for r in rows], [r["text"] for r in rows], min_match)
        return cls._read[key]

    def find(self, off: np.ndarray, words: np.ndarray, coverage: float) -> list[list[dict]]:
        """Per text the items that it covers."""
        out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
        for width, (h, owner, at, known, io, ih) in self.seeds.items():
            o, x = shingle_hashes(off, words, width, short=False)
            some = np.flatnonzero(known[x >> np.uint64(64 - FILTER)])
            lo, hi = np.searchsorted(h, x[some]), np.searchsorted(h, x[some], side="right")
            some, lo, hi = some[hi > lo], lo[hi > lo], hi[hi > lo]
            rows = np.searchsorted(o, some, side="right") - 1
            for i in np.unique(rows):
                a, b = np.searchsorted(rows, [i, i + 1])
                # each different seed of the text once, with its places in the items
                first, seed = np.unique(lo[a:b], return_inverse=True)
                count = np.searchsorted(h, h[first], side="right") - first
                place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                number, who = np.repeat(np.arange(len(first)), count), owner[place]
                order = np.argsort(who, kind="stable")
                for j, c, d in zip(*_runs(who[order]), strict=True):
                    mine = order[c:d]
                    # no tiling can cover more words than the places that have a seed
                    places = np.unique(at[place[mine]])
                    most = int(np.minimum(np.diff(np.append(places, places[-1] + width)), width).sum())
                    if most < coverage * self.n[j]:
                        continue
                    hits = np.flatnonzero(np.isin(seed, number[mine]))
                    own, item = x[o[i] : o[i + 1]], ih[io[j] : io[j + 1]]
                    p, q = matches(seed[hits], number[mine], np.append(np.uint64(0), own)[some[a:b][hits] - o[i]], np.append(np.uint64(0), item)[at[place[mine]]], some[a:b][hits] - o[i], at[place[mine]])
                    tiles = tile(p, q, grown(p, q, own, item, width), width, int(off[i + 1] - off[i]), int(self.n[j]))
                    covered = sum(k for _, _, k in tiles)
                    if covered >= coverage * self.n[j]:
                        out[i].append({"item_id": self.ids[j], "words": int(self.n[j]), "covered": covered, "coverage": covered / int(self.n[j]), "tiles": [{"start": p, "item_start": q, "length": k} for p, q, k in tiles]})
        return out


def _runs(x: np.ndarray) -> tuple[list, list, list]:
    """Value, first and end of each run of equal values."""
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return x[edge].tolist(), edge.tolist(), np.append(edge[1:], len(x)).tolist()


def tiled(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, into: str = "tiles", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df with the items that each text covers: an array, empty for clean texts."""
    out = df.withColumn(into, F.array().cast(TILES))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-total_bytes(items, "text") // block_bytes))
    folder = shared_dir(df.sparkSession, "items")
    items.withColumn("block", F.pmod(F.xxhash64("text", "id"), F.lit(blocks))).repartition(F.col("block")).write.mode("overwrite").partitionBy("block").parquet(folder)
    # with more blocks than a worker holds, each is read again for every so many bytes of text
    limit = CHUNK_BYTES if blocks <= BLOCKS_HELD else PASS_BYTES

    def searched(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [[[] for _ in range(chunk.num_rows)] for chunk, _, _ in pieces]
        for number in range(blocks):
            for rows, (_, off, words) in zip(found, pieces, strict=True):
                for mine, new in zip(rows, Items.of(folder, number, min_match).find(off, words, coverage), strict=True):
                    mine += new
        for rows, (chunk, _, _) in zip(found, pieces, strict=True):
            field = chunk.schema.field(into)
            ordered = [sorted(x, key=lambda r: (r["item_id"] is not None, r["item_id"] or 0)) for x in rows]
            yield from chunk.set_column(chunk.schema.get_field_index(into), field, pa.array(ordered, field.type)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for chunk in sliced(batches, text):  # words are hashed CHUNK_BYTES at a time, however many blocks there are
            pieces.append((chunk, *word_hashes(chunk.column(text))))
            size += chunk.nbytes
            if size >= limit:
                yield from searched(pieces)
                pieces, size = [], 0
        if pieces:
            yield from searched(pieces)

    return out.mapInArrow(run, out.schema)


def op5(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = tiled(documents.select("doc_id", "text"), benchmark).drop("text").where(F.size("tiles") > 0)
    return found.select("doc_id", F.explode("tiles").alias("x")).select("doc_id", "x.*")
