"""Token ids in a compact binary file format, and reading it back.

Ids are replaced by their frequency rank over the whole corpus, so that common
ids are small, and each rank takes one to four bytes. The byte lengths stand
apart as two-bit codes, four in a control byte; the reader looks each control
byte up in a table of 256 rows of four lengths and gathers the data bytes.

A folder holds `ids/` (rank to id, Parquet), `part-NNNNN.qtk` and `manifest/` (a row per
file). A file is a run of blocks, little-endian throughout:

    magic 4 bytes "QTK1" | documents u32 | ids u64 | control bytes u64 | data bytes u64
    flags of documents whose id is null u8[documents] | doc_id i64[documents] | ids of each document u64[documents]
    control bytes | data bytes

Documents stand in ascending doc_id order (nulls first, ties by the hash of the text) over all
files. Two passes over the corpus: one encodes it and counts, one deals the encoded
documents out by doc_id range and writes. The ids go from one to the other by a
table in the shared folder as 16-bit or 32-bit integers, so nothing is encoded twice
and a lost executor costs its own tasks only. Writers use temporary names and rename; what they
write is the same in each attempt.

Defined results: a null or empty text is encoded as the end id alone; texts are taken whole; rows with one id and one text follow each
other; the order of rows with one id and equal hashes is the order of the table. Other columns of df are not written, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, encode_with, remembered
from .common import kept, range_id, shared_dir, sliced

HEADER, MAGIC = "<4sIQQQ", b"QTK1"
#: Ids in a block, and bytes of a part file, about.
BLOCK_IDS, PART_BYTES = 1 << 20, 32 << 20
#: Bytes of text that are encoded at a time: the more, the fewer times a piece is looked up.
ENCODED_BYTES = 4 << 20
#: Pieces in a list that the tokenizers library is called with.
CALL = 4096
#: Lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    n = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = n - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again."""
    n = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(n) - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(count, np.uint32)
    for k in range(4):
        has = n > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Library:
    """The tokenizers library over distinct pieces of text."""

    _read: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spec = Vocabulary(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold none; Vocabulary.cut finds them in the texts
        self.lengths = np.array([len(x) for x in self.spec.strings])
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Library:
        if path not in cls._read:
            cls._read.clear()
            cls._read[path] = cls(path)
        return cls._read[path]

    def pieces(self, words: list[bytes]) -> list[bytes]:
        def merged(new: list[bytes]) -> list[bytes]:
            # thousands of pieces to a call; a byte-level token's length in bytes tells where the next piece begins
            texts = [w.decode() for w in new]
            found = self.tokenizer.encode_batch_fast([texts[k : k + CALL] for k in range(0, len(texts), CALL)], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
            ends = np.cumsum([0, *map(len, new)])
            at = np.append(0, np.cumsum(self.lengths[ids]))
            off = np.searchsorted(at, ends)
            if at[-1] != ends[-1] or (at[off] != ends).any():
                raise ValueError("tokens run over the ends of pieces")
            raw, off = ids.tobytes(), (4 * off).tolist()
            return [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

        return remembered(self.known, words, merged)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        v = self.spec
        return encode_with(texts, v.special, v.cut, v.prepare, v.spaced, self.pieces)


def encoded(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tie, raw): the ids of each whole text and end_id, as little-endian integers of 16 bits where all ids fit, else 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in sliced(batches, text, ENCODED_BYTES):
            library = Library.of(path)
            kind = "<u2" if library.spec.size <= 0xFFFF else "<u4"
            ids, off = library.encode(chunk.column(text).to_pylist())
            ids, off = np.insert(ids, off[1:], end_id).astype(kind), off + np.arange(len(off))
            raw = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * ids.itemsize).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield from pa.table({key: chunk.column(key), "tie": chunk.column("tie"), "raw": raw}).combine_chunks().to_batches()

    return df.select(key, text, F.xxhash64(text).alias("tie")).mapInArrow(run, f"{key} long, tie long, raw binary")


def frequencies(table: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents; each task sends a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column(0).to_pylist()), f"<u{width}")
            total = np.pad(total, (0, max(0, int(ids.max(initial=0)) + 1 - len(total))))
            total += np.bincount(ids, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": some.astype(np.int64), "n": total[some]})

    return table.select("raw").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """The documents of df as a folder in this format.

    Only the ids that occur (a vocabulary's size at most) come to the driver, to be ranked.
    """
    spark = df.sparkSession
    table = kept(encoded(df, path, end_id, key, text), "ids")
    width = 2 if Vocabulary.of(path).size <= 0xFFFF else 4
    ranked = [r.id for r in frequencies(table, width).orderBy(F.desc("n"), "id").toLocalIterator()]
    ids = np.array(ranked, dtype=np.uint32)
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ids")
    size = table.agg(F.sum(F.length("raw"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    dealt = table.withColumn("part", range_id(table, key, "tie", parts)).repartitionById(parts, "part").sortWithinPartitions("part", F.asc_nulls_first(key), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        rank[ids] = np.arange(len(ids))
        files, base = _open(folder)
        part, out, held, count, rows, total = None, None, [], 0, 0, 0
        for b in batches:
            for k, raw, p in zip(b.column(key).to_pylist(), b.column("raw").to_pylist(), b.column("part").to_pylist(), strict=True):
                if out is None:
                    part, temporary = p, f"{base}/.tmp-{p:05d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(temporary)
                held.append((k, raw))
                count += len(raw) // width
                rows, total = rows + 1, total + len(raw) // width
                if count >= BLOCK_IDS:
                    out.write(block(held, rank, width))
                    held, count = [], 0
        if out is not None:
            if held:
                out.write(block(held, rank, width))
            out.close()
            files.move(temporary, f"{base}/part-{part:05d}.qtk")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": pa.array([rows], pa.int64()), "ids": pa.array([total], pa.int64())})

    dealt.mapInArrow(run, "part int, documents long, ids long").write.mode("overwrite").parquet(f"{folder}/manifest")


def block(held: list[tuple[int | None, bytes]], rank: np.ndarray, width: int) -> bytes:
    ids = np.frombuffer(b"".join(x for _, x in held), f"<u{width}")
    control, data = pack(rank[ids])
    null = np.array([k is None for k, _ in held], np.uint8)
    keys = np.array([k or 0 for k, _ in held], "<i8")
    sizes = np.array([len(x) // width for _, x in held], "<u8")
    return b"".join((struct.pack(HEADER, MAGIC, len(held), len(ids), len(control), len(data)), null.tobytes(), keys.tobytes(), sizes.tobytes(), control, data))


def read(spark: SparkSession, folder: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids array<long>), or with digest ids_crc32 in place of the ids, from a folder of this format."""
    from pyspark.sql import Window

    parts = spark.read.parquet(f"{folder}/manifest")
    n = max(1, parts.count())
    # a row per file: a manifest is small however many documents there are
    in_order = Window.orderBy("part")
    starts = parts.select("part", (F.sum("ids").over(in_order) - F.col("ids")).alias("before"), (F.row_number().over(in_order) - 1).alias("slot"))
    table = spark.read.parquet(f"{folder}/ids")
    ids = np.array([r.id for r in table.orderBy("rank").toLocalIterator()], dtype=np.uint32)  # a vocabulary at most
    last = "ids_crc32 long" if digest else "ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for b in batches:
            for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{base}/part-{part:05d}.qtk") as f:
                    while head := f.read(struct.calcsize(HEADER)):
                        magic, docs, count, controls, datas = struct.unpack(HEADER, head)
                        if magic != MAGIC:
                            raise ValueError(f"part {part} is damaged")
                        null, keys, sizes = np.frombuffer(f.read(docs), bool), np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(8 * docs), "<u8").astype(np.int64)
                        got = ids[unpack(f.read(controls), f.read(datas), count)]
                        ends = np.cumsum(sizes)
                        if digest:
                            raw = memoryview(np.ascontiguousarray(got, "<u4")).cast("B")
                            value = pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.int64())
                        else:
                            value = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(got.astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(at + ends - sizes), pa.array(sizes), value], names=[key, "start", "n_tokens", last.split()[0]])
                        at += count

    return starts.repartitionById(n, F.col("slot")).mapInArrow(run, f"{key} long, start long, n_tokens long, {last}")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read(spark, folder, digest=True)
