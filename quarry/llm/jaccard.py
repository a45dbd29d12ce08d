"""Similarity join of texts by the Jaccard similarity of their word shingles: the chosen-path join.

Texts become sets of five-word shingles. Every run splits the sets recursively: a
set goes to a child for each shingle whose hash on this level falls below
BRANCH / (similarity x set size), so that similar sets sample shared shingles. Buckets
of up to BRUTE sets are compared by brute force; larger ones are split again, up
to LEVELS times. The shingles chosen on a level are the
same for all buckets of a run. Sets of a pair at the threshold share Poisson(BRANCH) of them at
least (exactly that if one set holds the other), so a run takes the pair to a bucket of level k with probability
(1 - exp(-BRANCH)) ** k. Runs are repeated until the pair is found with probability `recall`: few
for sets that are in small buckets only, more for those of which a bucket was split.

Groups of near copies choose the same shingles on every level and stay together. Such buckets are compared
by pivots, not by all pairs: a pivot is compared with every set, similar ones join its component, and since the Jaccard distance is a metric,
members whose distance to the pivot is less by more than the threshold than that of all sets outside need no
comparison of their own. Buckets above BLOCK_SETS are dealt over blocks; each block is solved in one
task, its pivots go to the other blocks of the bucket, and only blocks whose components come too near to be told apart, and which nothing else
has connected, are compared with each other. So a group of m near copies costs about m comparisons, and no link that would connect two texts is lost.

The result is one row per row of the input with its class (the connected component), the copies' representative (text_id) and the number of all its links
to different texts (n_links), and one row for each link between representatives that was verified and holds the class together: without any of them parts of a class would
fall asunder, and no class is held together by anything else. Buckets yield the classes. Links lie within classes only, so link_counts() then compares all pairs
of each class once, in blocks of bounded size that are dealt over tasks; sets whose sizes alone rule a link out are not compared, and pairs are counted where they are
found, for a group of m near copies has about m x m / 2 of them. representatives() needs no more than the classes and leaves this step out.

Defined results: words are lower-case runs between white space; a text with
fewer than five words is one shingle; texts without words are copies only of equal
texts; null texts are alone, without links; equal rows are copies, and so are texts with one set. class_id is the smallest key of
the class (null if all its keys are null), text_id the smallest key of the text's copies. representatives() keeps one row of each class, also where
texts of the class are not similar to the one kept but to others between them. join() returns its own columns only, whatever other columns df has; representatives() passes all of them through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, forget, kept, mix, seeded, shingle_hashes, sliced, word_hashes
from .components import components

LEVELS, BRANCH, BRUTE, RECALL = 3, 1.5, 64, 0.999
#: Sets and shingles in a block of a bucket, about; sets up to which a block is compared by products of matrices.
BLOCK_SETS, BLOCK_SHINGLES, DENSE = 2048, 1_000_000, 256
#: Sets of a class in a block whose links are all counted, about: a task holds two blocks.
COUNTED = 1024


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> tuple[int, int]:
    """Runs for all sets and runs for sets with a split bucket: with both, a pair at the threshold is found with probability `recall`.

    The first number finds pairs whose buckets are all small, the second pairs whose buckets are all split to the last level;
    the misses of both add up to 1 - recall at most.
    """
    once = 1 - math.exp(-BRANCH)
    few = math.ceil(math.log((1 - recall) / 4) / math.log(1 - once))
    missed = math.exp(-BRANCH * few)
    return few, max(few, math.ceil(math.log(1 - recall - missed) / math.log(1 - once**levels)))


def shingle_sets(texts, width: int = SHINGLE, lower: str = "utf8_lower") -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and the distinct shingle hashes of each in ascending order."""
    off, h = shingle_hashes(*word_hashes(texts, lower), width)
    for a, b in zip(off[:-1], off[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[off[:-1][off[:-1] < len(h)]] = True
    return np.append(0, np.cumsum(keep))[off], h[keep]


def set_ids(off: np.ndarray, h: np.ndarray, texts: list) -> list[bytes | None]:
    """A 128-bit id for each set; null for null texts. Sets without shingles are told apart by their text."""
    n = np.diff(off)
    some = n > 0
    sums = np.zeros((len(n), 2), np.uint64)
    if len(h):
        for k in range(2):
            sums[some, k] = np.add.reduceat(seeded(h, 101 + k), off[:-1][some])
    sums[:, 1] = mix(sums[:, 1] ^ n.astype(np.uint64))
    raw = sums.astype("<u8").tobytes()
    return [None if t is None else raw[16 * i : 16 * i + 16] if some[i] else b"\0" * 8 + hashlib.sha256(t.encode()).digest() for i, t in enumerate(texts)]


def signed(df: DataFrame, key: str, text: str, width: int, similarity: float, runs: int, levels: int) -> DataFrame:
    """(key, t, sid, n, picks): the hash of the text, the id and size of its set, and for each run and level the shingles chosen there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in sliced(batches, text):
            texts = chunk.column(text)
            off, h = shingle_sets(texts, width)
            n = np.diff(off)
            owner = np.repeat(np.arange(len(n)), n)
            bound = np.minimum(BRANCH / (similarity * np.maximum(n, 1)), 1.0) * (2.0**32 - 1)
            bound = bound.astype(np.uint32)[owner]
            rows, steps, picked = [], [], []
            for s in range(0, runs * levels, 2):
                x = seeded(h, s)
                for half, step in ((x.astype(np.uint32), s), ((x >> np.uint64(32)).astype(np.uint32), s + 1)):
                    if step < runs * levels:
                        at = np.flatnonzero(half <= bound)
                        rows.append(owner[at])
                        steps.append(np.full(len(at), step))
                        picked.append(h[at])
            cell = np.concatenate(rows) * (runs * levels) + np.concatenate(steps)
            order = np.argsort(cell, kind="stable")
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(cell, minlength=len(n) * runs * levels))), pa.int32()), pa.array(np.concatenate(picked)[order].view(np.int64)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (runs * levels), pa.int32()), inner)
            yield from pa.table({key: chunk.column(key), "t": chunk.column("t"), "sid": pa.array(set_ids(off, h, texts.to_pylist()), pa.binary()), "n": pa.array(n), "picks": outer}).combine_chunks().to_batches()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, text_hash(text).alias("t")).mapInArrow(run, f"{key} {kind}, t string, sid binary, n long, picks array<array<long>>")


def text_hash(text: str):
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text)), F.length(text))


def leaves(sets: DataFrame, few: int, runs: int, levels: int, brute: int = BRUTE) -> DataFrame:
    """(path, s, m, total): the buckets of all runs that hold two sets at least, each only once; m sets with total shingles in each.

    All sets take part in the first `few` runs, those with a bucket above `brute` in all of them.
    """
    pick = lambda level: F.explode(F.col("picks")[F.col("run") * levels + level])

    def counted(node: DataFrame) -> DataFrame:
        # counts are written, so that the join reads two plain exchanges and a path with very many sets can be split
        many = kept(node.groupBy("path").count().where("count > 1"), "counts")
        return kept(node.join(many, "path"), "paths")

    def first(some: DataFrame, a: int, b: int) -> DataFrame:
        node = some.select("s", "n", "picks", F.explode(F.sequence(F.lit(a), F.lit(b - 1))).alias("run"))
        return counted(node.select("s", "n", "run", pick(0).alias("token")).select("s", "n", "run", F.xxhash64("run", "token").alias("path")))

    node = first(sets, 0, few)
    # only sets with a large bucket go deeper; their number grows with the data, so they are never broadcast
    split = kept(sets.join(kept(node.where(F.col("count") > brute).select("s").distinct(), "split").hint("merge"), "s", "left_semi"), "deeper")
    if runs > few:
        node = node.unionByName(first(split, few, runs))
    done = None
    for level in range(levels):
        if level:
            node = node.join(split.select("s", "picks"), "s").select("s", "n", "run", pick(level).alias("token"), "path").select("s", "n", "run", F.xxhash64("path", "token").alias("path"))
            node = counted(kept(node, "nodes"))
        last = level == levels - 1
        leaf = (node if last else node.where(F.col("count") <= brute)).select("path", "s", "n")
        done = leaf if done is None else done.union(leaf)
        node = node.where(F.col("count") > brute).drop("count")
    return unique(done)


def unique(done: DataFrame) -> DataFrame:
    """(path, s, m, total) of the buckets (path, s, n): of buckets with the same sets one stays; m sets with total shingles."""
    marks = done.groupBy("path").agg(F.expr("bit_xor(xxhash64(s))").alias("a"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "s"), 20)).alias("b"), F.count("*").alias("m"), F.sum("n").alias("total"))
    first = kept(marks.groupBy("a", "b", "m").agg(F.min("path").alias("path"), F.max("total").alias("total")).select("path", "m", "total"), "marks")
    return kept(done.join(first, "path").select("path", "s", "m", "total"), "leaves")


class Block:
    """The sets of a block with their tokens' places, for the similarity of one set to all."""

    def __init__(self, rows: list[np.ndarray]):
        self.m, self.n = len(rows), np.array([len(r) for r in rows], np.int64)
        every = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.token, first = np.unique(every[order], return_index=True)
        self.owner = np.repeat(np.arange(self.m), self.n)[order]
        self.first = np.append(first, len(every))

    def similarity(self, h: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of the sorted set h to each set of the block."""
        at = np.minimum(np.searchsorted(self.token, h), max(len(self.token) - 1, 0))
        at = at[self.token[at] == h] if len(self.token) else at[:0]
        a, n = self.first[at], self.first[at + 1] - self.first[at]
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[place], minlength=self.m)
        return shared / np.maximum(self.n + len(h) - shared, 1)


def forest(sim: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that hold the components of a small block together, from the similarities of all its pairs."""
    ok = sim >= similarity - 1e-9
    np.fill_diagonal(ok, False)
    seen, out = ~ok.any(1), []
    for start in np.flatnonzero(~seen):
        if seen[start]:
            continue
        seen[start], front = True, np.array([start])
        while len(front):
            new = ok[front] & ~seen
            to = np.flatnonzero(new.any(0))
            out += zip(front[new[:, to].argmax(0)].tolist(), to.tolist(), strict=True)
            seen[to], front = True, to
    return out


def products(rows: list[np.ndarray]) -> np.ndarray:
    """The similarities of all pairs of a small block, by products of incidence matrices."""
    m, n = len(rows), np.array([len(r) for r in rows], np.float32)
    token, inverse, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    column = np.cumsum(seen > 1) - 1
    use = (seen > 1)[inverse]
    owner, col = owner[use], column[inverse[use]]
    order = np.argsort(col, kind="stable")
    owner, col, shared = owner[order], col[order], np.zeros((m, m), np.float32)
    for k in range(0, int((seen > 1).sum()), 4096):
        a, b = np.searchsorted(col, [k, k + 4096])
        grid = np.zeros((m, 4096), np.float32)
        grid[owner[a:b], col[a:b] - k] = 1
        shared += grid @ grid.T
    # float sums are exact for sets below 2**24 shingles
    return shared.astype(np.float64) / np.maximum(n[:, None] + n[None, :] - shared, 1)


def peel(rows: list[np.ndarray], similarity: float, alone: bool = True) -> tuple[list[tuple[int, int, float]], np.ndarray, np.ndarray]:
    """Links, component and reach of each set of a block; reach is -1 for sets that were no pivots.

    A pivot is compared with all sets. Sets that are not compared themselves lie in a component that is closed: with d the
    Jaccard distance (a metric), its members x and a set y outside have d(x, y) >= d(y, pivot) - d(x, pivot), and this is above the threshold for all y
    that are no pivots. One pivot of such a component has as reach the largest distance to its members that are no pivots.
    """
    m = len(rows)
    sim = products(rows) if m <= DENSE else None
    if sim is not None and alone:  # nothing but the links is asked for
        links = forest(sim, similarity)
        label = np.arange(m)
        for a, b in links:  # in the order of a search from the smallest, so that labels are final
            label[b] = label[a]
        return [(a, b, float(sim[a, b])) for a, b in links], label, np.zeros(m)
    block, far = Block(rows) if sim is None else None, 1 - similarity + 1e-9
    label, reach, waiting = np.arange(m), np.full(m, -1.0), np.ones(m, bool)
    links, distance = [], {}
    while waiting.any():
        at = np.flatnonzero(waiting)
        size = np.bincount(label, minlength=m)[label[at]]
        if reach.max() >= 0 and (label[at] == label[at[0]]).all() and size[0] > 1:
            break
        p = int(at[size.argmin()])
        d = 1 - (block.similarity(rows[p]) if sim is None else sim[p])
        near = np.flatnonzero((d <= far) & (np.arange(m) != p))
        new = near[label[near] != label[p]]
        first = new[np.unique(label[new], return_index=True)[1]]
        links += [(p, int(x), float(1 - d[x])) for x in first]
        label[np.isin(label, np.append(label[new], label[p]))] = label[p]
        reach[p], waiting[p] = 0, False
        distance[p] = d
        mine, out = waiting & (label == label[p]), waiting & (label != label[p])
        if not out.any() or not mine.any() or d[out].min() > d[mine].max() + far:
            waiting &= ~mine
    for c in np.unique(label[reach < 0]):
        mine = np.flatnonzero((label == c) & (reach < 0))
        pivots = [p for p in np.flatnonzero((label == c) & (reach >= 0)) if p in distance]
        if not pivots:
            reach[mine] = 0
            continue
        best = min(pivots, key=lambda p: distance[p][mine].max())
        reach[best] = max(1e-12, distance[best][mine].max())
    return links, label, reach


FOUND = "path long, c int, s binary, other binary, similarity double, reach double"


def grouped(df: DataFrame, text: str, width: int, by: list[str], work, lower: str = "utf8_lower") -> DataFrame:
    """FOUND rows of work(rows) for each group of rows with equal `by`; each row has its sorted shingles as h."""

    order = [x for x in df.columns if x != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for chunk in sliced(batches, text):
            off, h = shingle_sets(chunk.column(text), width, lower)
            for r, a, b in zip(chunk.drop_columns([text]).to_pylist(), off[:-1], off[1:], strict=True):
                r["h"] = h[a:b]
                if (now := tuple(r[x] for x in by)) != at:
                    out += work(held)
                    held, at = [], now
                if not held or any(held[-1][x] != r[x] for x in order):  # equal rows of the input come once
                    held.append(r)
            if len(out) > 5000:
                yield _found(out)
                out = []
        out += work(held)
        if out:
            yield _found(out)

    return df.repartition(*by).sortWithinPartitions(*by, *(x for x in order if x not in by)).mapInArrow(run, FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "c", "s", "other", "similarity", "reach"])


def links(buckets: DataFrame, texts: DataFrame, text: str, width: int, similarity: float, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES, lower: str = "utf8_lower") -> DataFrame:
    """(s, other, similarity): links that connect all similar sets of each bucket, at most one a set and block or pivot."""

    def alone(rows: list[dict]) -> Iterator[tuple]:
        """The links of a block; if the bucket has others, also its sets with component and reach (similarity is null)."""
        rows.sort(key=lambda r: r["s"])
        if len(rows) < 2 and not (rows and rows[0]["b"] > 1):
            return
        found, label, reach = peel([r["h"] for r in rows], similarity, rows[0]["b"] == 1)
        path, c = rows[0]["path"], rows[0]["c"]
        for a, b, x in found:
            yield path, c, rows[a]["s"], rows[b]["s"], x, None
        if rows[0]["b"] > 1:
            for r, k, x in zip(rows, label, reach, strict=True):
                yield path, c, r["s"], rows[k]["s"], None, float(x)

    def probed(rows: list[dict]) -> Iterator[tuple]:
        """The links of other blocks' pivots into this block; and (similarity is null) the components that lie so near to a pivot's own that members may be linked."""
        base, probes = ([r for r in rows if (r["home"] is None) == own] for own in (True, False))
        if not base or not probes:
            return
        block = Block([r["h"] for r in base])
        names, label = np.unique(np.array([r["other"] for r in base], object), return_inverse=True)
        open_ = np.array([r["reach"] < 0 for r in base])
        for r in probes:
            x = block.similarity(r["h"])
            order = np.argsort(-x, kind="stable")
            order = order[x[order] >= similarity - 1e-9]
            for k in order[np.unique(label[order], return_index=True)[1]]:
                yield r["path"], r["c"], r["s"], base[k]["s"], float(x[k]), None
            if r["reach"] > 0:
                for k in np.unique(label[(x < similarity) & (1 - x <= 1 - similarity + r["reach"] + 1e-9) & open_]):
                    yield r["path"], r["c"], r["s"], names[k], None, float(r["home"])

    def both(rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r["s"])
        for a, b, x in peel([r["h"] for r in rows], similarity)[0] if len(rows) > 1 else []:
            yield rows[0]["path"], 0, rows[a]["s"], rows[b]["s"], x, None

    blocks = F.greatest(F.ceil(F.col("m") / block_sets), F.ceil(F.col("total") / block_shingles), F.lit(1)).cast("int")
    dealt = buckets.withColumn("b", F.when(F.col("m") <= 8, 1).otherwise(blocks)).withColumn("c", F.pmod(F.xxhash64("s", "path"), "b").cast("int"))
    found = kept(grouped(dealt.select("path", "c", "b", "s").join(texts, "s"), text, width, ["path", "c"], alone, lower), "linked")
    edges = found.where("similarity is not null").select("s", "other", "similarity")
    members = found.where("similarity is null").select("path", "c", "s", "other", "reach")
    if not members.take(1):
        return edges
    # pivots go to the other blocks of their bucket: few rows, however many sets a bucket has
    of = dealt.where("b > 1").select("path", "b").distinct()
    pivots = members.where("reach >= 0").join(of, "path").select("path", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("to"), "s", "other", "reach", F.col("c").alias("home")).where("`to` <> home")
    asked = members.withColumn("home", F.lit(None).cast("int")).unionByName(pivots.withColumnRenamed("to", "c"))
    crossed = kept(grouped(asked.join(texts, "s"), text, width, ["path", "c"], probed, lower), "crossed")
    edges = edges.union(crossed.where("similarity is not null").select("s", "other", "similarity"))
    near = crossed.where("similarity is null")
    if not near.take(1):
        return edges
    part = kept(components(edges.select(F.col("s").alias("u"), F.col("other").alias("v"))), "parts")
    near = near.join(part.select(F.col("node").alias("s"), F.col("root").alias("mine")), "s", "left").join(part.select(F.col("node").alias("other"), F.col("root").alias("its")), "other", "left")
    near = near.where("coalesce(mine, s) <> coalesce(its, other)").select("path", F.col("reach").cast("int").alias("i"), F.col("c").alias("j"))
    near = near.select("path", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    rows = members.select("path", "c", "s").join(near, "path").where("c = i or c = j").drop("c")
    more = grouped(rows.join(texts, "s"), text, width, ["path", "i", "j"], both, lower)
    return edges.union(kept(more, "both").select("s", "other", "similarity"))


def link_counts(members: DataFrame, texts: DataFrame, text: str, width: int, similarity: float, block_sets: int = COUNTED, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(s, n_links): the number of all sets that are similar to each set of the classes of members (s, n, root), where n is the size of the set.

    Small classes are one block. The sets of others go by the power of 1 / similarity that their size reaches, for sets that are two powers apart cannot be similar, and
    each power is dealt over blocks. Every two blocks of one power or of neighbouring ones meet in one task, which returns a number for each of their sets and no pairs.
    """

    def met(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        least, first = similarity - 1e-9, [(r["k"], r["c"]) == (r["i"], r["a"]) for r in rows]
        if all(first):  # one block by itself
            if (rows[0]["i"], rows[0]["a"]) != (rows[0]["j"], rows[0]["b"]):
                return
            hashes = [r["h"] for r in rows]
            block = Block(hashes) if len(rows) > DENSE else None
            n = (products(hashes) >= least).sum(1) - 1 if block is None else [int((block.similarity(h) >= least).sum()) - 1 for h in hashes]  # each is similar to itself
            yield from ((0, int(x), r["s"], None, None, None) for x, r in zip(n, rows, strict=True) if x)
            return
        left, right = ([r for r, own in zip(rows, first, strict=True) if own == side] for side in (True, False))
        if not left:
            return
        block, n = Block([r["h"] for r in left]), np.zeros(len(left), np.int64)
        for r in right:
            near = block.similarity(r["h"]) >= least
            n += near
            if near.any():
                yield 0, int(near.sum()), r["s"], None, None, None
        yield from ((0, int(x), r["s"], None, None, None) for x, r in zip(n, left, strict=True) if x)

    sizes = kept(members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1"), "sizes")
    power = F.when((F.col("m") <= min(block_sets, DENSE)) & (F.col("total") <= block_shingles), 0).otherwise(F.floor(F.log("n") / (math.log(1 / similarity) * (1 + 1e-6)))).cast("int") if similarity < 1 else F.col("n").cast("int")
    rows = members.where("n > 0").join(sizes, "root").select("root", "s", "n", power.alias("k"))
    blocks = kept(rows.groupBy("root", "k").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")), "blocks")
    dealt = rows.join(blocks, ["root", "k"]).select("root", "s", "k", F.pmod(F.xxhash64("s", "root"), "blocks").cast("int").alias("c"))
    # each set with every block that it meets: those of its own power, of the next one and of the one before
    to = blocks.select("root", F.col("k").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("d"))
    near = blocks.select("root", "k", F.explode(F.array(F.col("k") - 1, "k", F.col("k") + 1)).alias("at")).join(to, ["root", "at"])
    low = (F.col("k") < F.col("at")) | ((F.col("k") == F.col("at")) & (F.col("c") <= F.col("d")))
    ends = [(F.when(low, x).otherwise(y)).alias(name) for x, y, name in ((F.col("k"), F.col("at"), "i"), (F.col("c"), F.col("d"), "a"), (F.col("at"), F.col("k"), "j"), (F.col("d"), F.col("c"), "b"))]
    asked = dealt.join(near, ["root", "k"]).select("root", "k", "c", "s", *ends)
    out = kept(grouped(asked.join(texts, "s"), text, width, ["root", "i", "a", "j", "b"], met).groupBy("s").agg(F.sum("c").alias("n_links")), "counted")
    forget(sizes, blocks)
    return out


def needed(df: DataFrame, key: str, text: str, sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """(s, text): for each set in a bucket the text of its row sets.one, by which it is compared."""
    need = buckets.select("s").distinct().join(sets.select(F.col("sid").alias("s"), F.col("one.k").alias("_k"), F.col("one.t").alias("_t")), "s")
    some = df.select(F.col(key).alias("k"), text_hash(text).alias("t"), F.col(text))
    return kept(some.join(need, some["k"].eqNullSafe(need["_k"]) & (some["t"] == need["_t"])).select("s", text), "needed")


def classes(df: DataFrame, key: str, text: str, similarity: float, width: int, recall: float, levels: int, brute: int, block_sets: int, block_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """signed() rows; per set (sid, class_id, text_id, n_copies, root, one): its class and its row with the smallest key; links(); needed() texts; the sizes (s, n) of sets."""
    few, runs = runs_for(recall, levels)
    marked = kept(signed(df, key, text, width, similarity, runs, levels), "signed")
    sets = kept(marked.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col(key).alias("k"), "t")).alias("one"), F.min(key).alias("k"), F.count("*").alias("n_copies")), "sets")
    picks = kept(marked.where("n > 0").dropDuplicates(["sid"]).select(F.col("sid").alias("s"), F.col("n").cast("int").alias("n"), "picks"), "picks")
    buckets = leaves(picks, few, runs, levels, brute)
    texts = needed(df, key, text, sets, buckets)
    edges = kept(links(buckets, texts, text, width, similarity, block_sets, block_shingles), "links")
    roots = components(edges.select(F.col("s").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("sid"), "root")
    of_set = kept(sets.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "roots")
    least = kept(of_set.groupBy("root").agg(F.min("k").alias("class_id")), "classes")
    return marked, kept(of_set.join(least, "root").withColumnRenamed("k", "text_id"), "sets"), edges, texts, picks.select("s", "n")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, recall: float = RECALL, levels: int = LEVELS, brute: int = BRUTE, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(key, class_id, text_id, n_copies, n_links, link_id, link_similarity): one row per row of df without link_id and with the number of all its links, and one per verified link that holds a class together with text_id as key."""
    marked, of_set, edges, texts, sizes = classes(df, key, text, similarity, width, recall, levels, brute, block_sets, block_shingles)
    # sets that are a class of their own have no link
    roots = of_set.groupBy("root").count().where("count > 1").select("root")
    linked = kept(of_set.join(roots, "root").select("root", F.col("sid").alias("s")).join(sizes, "s"), "members")
    counts = link_counts(linked, texts, text, width, similarity, min(block_sets, COUNTED), block_shingles)
    of_set = kept(of_set.join(counts.withColumnRenamed("s", "sid"), "sid", "left"), "counts")
    own = lambda c: F.when(F.col("sid").isNull(), F.col(key)).otherwise(F.col(c)).alias(c)
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    nothing = [F.lit(None).cast(df.schema[key].dataType).alias("link_id"), F.lit(None).cast("double").alias("link_similarity")]
    members = marked.select(key, "sid").join(of_set, "sid", "left").select(key, own("class_id"), own("text_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), n_links, *nothing)
    once = edges.groupBy(F.least("s", "other").alias("sid"), F.greatest("s", "other").alias("other")).agg(F.max("similarity").alias("link_similarity"))
    other = of_set.select(F.col("sid").alias("other"), F.col("text_id").alias("link_id"))
    pairs = once.join(of_set, "sid").join(other, "other").select(F.col("text_id").alias(key), "class_id", "text_id", F.col("n_copies").cast("long"), n_links, "link_id", "link_similarity")
    return members.unionByName(pairs)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, recall: float = RECALL, levels: int = LEVELS, brute: int = BRUTE, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of df that stay when one row of each class stays, the one with the smallest key; all rows with a null text stay."""
    _, of_set, *_ = classes(df, key, text, similarity, width, recall, levels, brute, block_sets, block_shingles)
    stay = kept(of_set.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.k").alias("_k"), F.col("one.t").alias("_t")), "stay")
    some = df.where(F.col(text).isNotNull()).withColumn("_text", text_hash(text))
    mine = some.join(stay, F.col("_text").eqNullSafe(F.col("_t")) & F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return mine.dropDuplicates([key, "_text"]).drop("_text").unionByName(df.where(F.col(text).isNull()))


def op7(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
