"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of BITS bits: the sides of random projections that halve a
sample. Sorted by it, the vectors that share a prefix stand together: a tree is a sorted array, cut by range into
blocks. A query finds its place in each tree's array by bisection and its longest prefixes there, and then goes up in all trees at the same
time, a bit a step, until the prefixes hold M candidates together; these are
compared by exact Euclidean distance, and only each block's best leave it.

M is measured on the index itself: for FIT_QUERIES of its vectors the true neighbours are found among all rows (a pass, in which
tasks keep k rows a query), and M is the smallest number whose recall for them is `recall` at least. It is a small constant where vectors have
neighbours that are much nearer than the rest, and a share of all rows where they have none, as for evenly spread vectors of many dimensions.

The projections' medians come from a bounded sample of SAMPLE vectors. Every row is indexed. Vectors are shuffled once for each tree,
queries to the blocks that their prefixes touch; a block with very many queries is
copied for each QUERIES of them. The table of blocks (MAX_BLOCKS rows about, whatever the number of vectors) is all that is broadcast beside the projections.
Beyond MAX_BLOCKS blocks grow with the vectors, but never in memory: a task holds a block's queries, and its rows pass by a batch at a time.

Equal vectors: no query needs more than the k + 1 smallest ids of a vector, so the index keeps these (exact), and
equal queries are searched once.

Defined results: vectors that are null, zero, hold null or non-finite components or have another length than most take no
part; ties go to the smaller id; a query finds all candidates if there are fewer than k; rows with a null id take no part; equal rows count once.
Only the result's columns are returned, whatever other columns df has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

TREES, BITS, SAMPLE, RECALL, BLOCK, MAX_BLOCKS, QUERIES, FIT_QUERIES, SEED = 10, 63, 4096, 0.95, 8192, 65_536, 50_000, 64, 7
#: The kinds of rows that come to a block, in this order.
QUERY, VECTOR = 0, 1
#: The bits behind a prefix, by its length.
FREE = np.array([(1 << (BITS - d)) - 1 for d in range(BITS + 1)], np.int64)
ROWS = "tree int, block int, part int, kind int, code long, id long, level int, v array<double>"


class Forest:
    """Projections and medians."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.trees = trees
        dim = sample.shape[1] if sample.size else 1
        self.planes = np.random.default_rng(seed).standard_normal((dim, trees * BITS))
        self.middle = np.median(sample @ self.planes, axis=0) if sample.size else np.zeros(trees * BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A code of BITS bits per row and tree."""
        bits = (x @ self.planes > self.middle).reshape(len(x), self.trees, BITS)
        return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


class Blocks:
    """First and last code and number of vectors of the blocks of each tree, in order."""

    def __init__(self, rows: list, trees: int):
        rows = sorted(rows, key=lambda r: (r.tree, r.low, r.block))
        self.of = [[r for r in rows if r.tree == t] for t in range(trees)]
        self.number = [np.array([r.block for r in x], np.int64) for x in self.of]
        self.low = [np.array([r.low for r in x], np.int64) for x in self.of]
        self.high = [np.array([r.high for r in x], np.int64) for x in self.of]
        self.before = [np.append(0, np.cumsum([r.n for r in x])) for x in self.of]

    def touched(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first block and the one behind the last that hold codes from low to high."""
        return np.searchsorted(self.high[tree], low), np.searchsorted(self.low[tree], high, side="right")


def prefix(codes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest code with the same first `level` bits."""
    free = FREE[level]
    return codes & ~free, codes | free


def usable(v: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Counting:
    """How many codes of a block share each prefix of the queries that come to it."""

    def __init__(self, blocks: Blocks, tree: int, block: int, some: pa.Table):
        self.ids, c = some.column("id"), some.column("code").to_numpy()
        self.bounds = [prefix(c, d) for d in range(BITS + 1)]
        self.out = np.zeros((len(c), BITS + 1), np.int64)
        own = int(np.flatnonzero(blocks.number[tree] == block)[0])
        for d, (low, high) in enumerate(self.bounds):
            first, end = blocks.touched(tree, low, high)  # other blocks that the prefix touches count as a whole
            size = blocks.before[tree][own + 1] - blocks.before[tree][own]
            self.out[:, d] = blocks.before[tree][end] - blocks.before[tree][first] - np.where((first <= own) & (own < end), size, 0)

    def add(self, rows: pa.RecordBatch) -> None:
        x = rows.column("code").to_numpy()
        for d, (low, high) in enumerate(self.bounds):
            self.out[:, d] += np.searchsorted(x, high, side="right") - np.searchsorted(x, low)

    def result(self) -> pa.RecordBatch:
        n = len(self.out)
        return pa.RecordBatch.from_arrays([self.ids.combine_chunks(), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (BITS + 1), pa.int32()), pa.array(self.out.ravel()))], names=["id", "counts"])


class Nearest:
    """The `most` nearest rows of a block for each query that comes to it, kept while the block's rows go by."""

    def __init__(self, most: int, some: pa.Table):
        self.most, self.ids, self.v = most, some.column("id").to_numpy(), _matrix(some.column("v"))
        self.low, self.high = prefix(some.column("code").to_numpy(), some.column("level").to_numpy())
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(self.ids)

    def add(self, rows: pa.RecordBatch) -> None:
        x, ids, code = _matrix(rows.column("v")), rows.column("id").to_numpy(), rows.column("code").to_numpy()
        norms, first, end = (x**2).sum(1), np.searchsorted(code, self.low), np.searchsorted(code, self.high, side="right")
        for q in np.flatnonzero(end > first).tolist():
            a, b, z = first[q], end[q], self.v[q]
            far = norms[a:b] - 2 * (x[a:b] @ z)
            bound = np.partition(far, self.most - 1)[self.most - 1] + 1e-9 * (norms[a:b].max() + z @ z) if b - a > self.most else np.inf
            near = a + np.flatnonzero(far <= bound)
            score = np.sqrt(((x[near] - z) ** 2).sum(1))  # the measure itself, for all that rounding could have hidden
            every, far = np.append(self.found[q][0], ids[near]), np.append(self.found[q][1], score)
            best = np.lexsort((every, far))[: self.most]
            self.found[q] = every[best], far[best]

    def result(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([f[0] for f in self.found])), pa.array(np.concatenate([f[1] for f in self.found]))], names=["q", "id", "score"])


def met(rows: DataFrame, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What work(tree, block, queries) gathers over the rows of each block: QUERIES queries at most are held, and the block's rows pass in the order of their codes, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, worker = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("tree", "block", "part", "kind")], 1)
            edge = np.append(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key))
            start = 0
            for end in edge.tolist():
                group, kind, some = tuple(key[start, :3].tolist()), key[start, 3], b.slice(start, end - start)
                start = end
                if group != at:
                    if worker is not None:
                        yield worker.result()
                    at, waiting, worker = group, [], None
                if kind == QUERY:
                    waiting.append(some)
                elif waiting or worker is not None:
                    worker = worker or work(group[0], group[1], pa.Table.from_batches(waiting).combine_chunks())
                    waiting = []
                    worker.add(some)
        if worker is not None:
            yield worker.result()

    both = rows.unionByName(queries).repartition("tree", "block", "part")
    return both.sortWithinPartitions("tree", "block", "part", "kind", "code", "id").mapInArrow(run, schema)


def search(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of df for each row of queries, of which its own id is none."""
    clean = lambda d: d.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = clean(df), clean(queries)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = most[0] if most else 0
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    by_vector = Window.partitionBy("v").orderBy("id")
    index = kept(rows.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).drop("r"), "vectors")
    # the queries with one vector are searched as the smallest of them
    same = kept(asked.distinct(), "queries")
    ask = kept(same.groupBy("v").agg(F.min("id").alias("id")), "asked")
    by_hash = index.orderBy(F.xxhash64("id", F.lit(seed)), "id")
    sample = [r.v for r in by_hash.select("v").limit(SAMPLE).toLocalIterator()]
    spark, n = df.sparkSession, index.count()
    send = spark.sparkContext.broadcast(Forest(np.array(sample, dtype=np.float64).reshape(len(sample), dim or 1), trees, seed))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = send.value.codes(_matrix(b.column("v")))
                for t in range(send.value.trees):
                    yield _rows(t, 0, codes[:, t], b.column("id"), 0, b.column("v"), kind=VECTOR)

    # the sorted arrays: a range of (tree, code, id) in each partition, so that even equal codes are cut into blocks of even size
    parts = int(max(1, min(MAX_BLOCKS, -(-n * trees // BLOCK))))
    arrays = index.mapInArrow(coded, ROWS).repartitionByRange(parts, "tree", "code", "id").sortWithinPartitions("tree", "code", "id")
    arrays = kept(arrays.withColumn("block", F.spark_partition_id()), "forest")
    blocks = Blocks(arrays.groupBy("tree", "block").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n")).collect(), trees)
    known = spark.sparkContext.broadcast(blocks)

    def counts(some: DataFrame) -> DataFrame:
        """(id, counts): the candidates of each query over all trees, for prefixes of 0 to BITS bits."""

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = send.value.codes(_matrix(b.column("v"))) if b.num_rows else np.zeros((0, trees), np.int64)
                for t in range(trees if b.num_rows else 0):
                    at = np.maximum(np.searchsorted(known.value.low[t], codes[:, t], side="right") - 1, 0)
                    yield _rows(t, known.value.number[t][at], codes[:, t], b.column("id"), 0, None)

        each = met(arrays.withColumn("v", F.lit(None).cast("array<double>")), some.mapInArrow(placed, ROWS), lambda tree, block, some: Counting(known.value, tree, block, some), "id long, counts array<long>")
        return each.groupBy("id").agg(F.array(*(F.sum(F.col("counts")[d]) for d in range(BITS + 1))).alias("counts"))

    candidates = fitted(index, by_hash.limit(FIT_QUERIES), counts, send, k, recall)
    level = F.greatest(F.size(F.filter("counts", lambda c: c >= candidates)) - 1, F.lit(0)).cast("int")
    levels = kept(ask.join(counts(ask).select("id", level.alias("level")), "id"), "levels")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each query goes to."""
        for b in batches:
            if not b.num_rows:
                continue
            codes, at = send.value.codes(_matrix(b.column("v"))), b.column("level").to_numpy().astype(np.int64)
            for t in range(trees):
                first, end = known.value.touched(t, *prefix(codes[:, t], at))
                row = np.repeat(np.arange(len(at)), end - first)
                block = known.value.number[t][np.repeat(first - np.cumsum(end - first) + (end - first), end - first) + np.arange(len(row))]
                for a in range(0, len(row), 4096):
                    r = pa.array(row[a : a + 4096])
                    yield _rows(t, block[a : a + 4096], codes[row[a : a + 4096], t], b.column("id").take(r), at[row[a : a + 4096]], b.column("v").take(r))

    routed = kept(levels.select("id", "v", "level").mapInArrow(sent, ROWS), "routed")
    busy = routed.groupBy("tree", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).where("parts > 1")
    busy = kept(busy, "busy")
    split = lambda d, part: d.drop("part").join(busy, ["tree", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).drop("parts")
    found = met(split(arrays, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), split(routed, F.pmod(F.xxhash64("id"), "parts").cast("int")), lambda tree, block, some: Nearest(k + 1, some), "q long, id long, score double").distinct()
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("r") <= k + 1).drop("r")
    whole = top.join(ask.select(F.col("id").alias("q"), "v"), "q").select("v", F.col("id").alias("vec_id"), "score").join(same.select("v", F.col("id").alias("query_id")), "v")
    ranked = whole.where("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(index: DataFrame, some: DataFrame, counts: Callable, send, k: int, recall: float) -> int:
    """The candidates a query needs, from the true neighbours of `some` rows among all of the index."""
    asked = some.collect()  # FIT_QUERIES rows at most
    if not asked:
        return 1
    q, y = np.array([r.id for r in asked]), np.array([r.v for r in asked], dtype=np.float64)
    trees = send.value.trees
    mine = send.value.codes(y)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, far, shared = [np.zeros(0, np.int64)] * len(q), [np.zeros(0)] * len(q), [np.zeros(0, np.int64)] * len(q)
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b.column("v")), b.column("id").to_numpy()
            d = (x**2).sum(1) - 2 * y @ x.T
            for i in range(len(q)):
                at = np.flatnonzero(own != q[i])
                at = at[np.argsort(d[i, at], kind="stable")[:k]]
                both = send.value.codes(x[at]) ^ mine[i]
                longest = BITS - np.frexp(both.astype(np.float64))[1].min(1) if len(at) else np.zeros(0, np.int64)
                ids[i], far[i], shared[i] = np.append(ids[i], own[at]), np.append(far[i], d[i, at]), np.append(shared[i], longest)
                keep = np.argsort(far[i], kind="stable")[:k]
                ids[i], far[i], shared[i] = ids[i][keep], far[i][keep], shared[i][keep]
        who = np.repeat(q, [len(x) for x in ids])
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(ids)), pa.array(np.concatenate(far)), pa.array(np.concatenate(shared))], names=["q", "id", "far", "longest"])

    by_query = Window.partitionBy("q").orderBy("far", "id")
    true = index.mapInArrow(nearest, "q long, id long, far double, longest long").withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k).select("q", "longest").collect()
    total = {r.id: np.array(r.counts) for r in counts(some.select("id", "v")).collect()}
    longest = {i: np.array([r.longest for r in true if r.q == i]) for i in total}
    most = max(int(c[0]) for c in total.values())
    for m in sorted({int(2 ** (e / 4)) for e in range(4 * 3, 4 * int(np.ceil(np.log2(most + 1))) + 1)} | {most}):
        hit = [x >= max(int((total[i] >= m).sum()) - 1, 0) for i, x in longest.items() if len(x)]
        if not hit or np.concatenate(hit).mean() >= recall:
            return m
    return most


def _rows(tree: int, block, code: np.ndarray, ids: pa.Array, level, v: pa.Array | None, kind: int = QUERY) -> pa.RecordBatch:
    n = len(code)
    fill = lambda x: pa.array(np.broadcast_to(np.asarray(x), n).astype(np.int32))
    v = pa.nulls(n, pa.list_(pa.float64())) if v is None else v
    return pa.RecordBatch.from_arrays([fill(tree), fill(block), fill(0), fill(kind), pa.array(code), ids, fill(level), v], names=["tree", "block", "part", "kind", "code", "id", "level", "v"])


def op4(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(embeddings, embeddings.where("vec_id % 100 = 0"))
