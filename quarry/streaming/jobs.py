"""Structured Streaming jobs over the same transforms as the batch operators.

Sources are any streaming frames (files, queues, logs); offsets and state live in the checkpoint, so a lost executor or a restart
repeats a micro-batch. Sinks are therefore written so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.catalog import upsert
from ..sources import store
from ..sources.readers import extracted

CONVERSATION_DAYS, QUOTA_DAYS = 14, 2
#: Buckets of a table that streams merge into.
BUCKETS = 16


def files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_batch: int | None = None, **options: str) -> DataFrame:
    """New files of a folder as a stream; per_batch bounds the files of a micro-batch."""
    reader = spark.readStream.schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).format(kind).load(path)


def arriving(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """New binary files, extracted to Markdown."""
    raw = files(spark, path, "path string, modificationTime timestamp, length long, content binary", "binaryFile", per_batch, recursiveFileLookup="true")
    return extracted(raw.withColumn("filename", F.element_at(F.split("path", "/"), -1)))


def drained(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Runs a stream over all that is there now, batch by batch."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


class Table:
    """A table of Parquet buckets by key, for sinks without a transactional format: each micro-batch writes version <batch + 1> of the buckets that its keys lie in, and of no others.

    A bucket's rows are those of its last version. A repeated batch writes its versions again, from the same ones before, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], keep: tuple[str, ...] = (), add: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.keep, self.add, self.buckets = spark, folder, schema, keys, keep, add, buckets

    def _paths(self, n: int, buckets: list[int]) -> list[str]:
        """The folder of each bucket's last version up to n: a listing a bucket."""
        out = []
        for b in buckets:
            there = [int(x.removeprefix("_version=")) for x in store.listed(self.spark, f"{self.folder}/_bucket={b}") if x.startswith("_version=")]
            if there := [v for v in there if v <= n]:
                out.append(f"{self.folder}/_bucket={b}/_version={max(there)}")
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def version(self, n: int) -> DataFrame:
        """The table after n micro-batches."""
        return self._read(self._paths(n, list(range(self.buckets))))

    def merge(self, batch: DataFrame, number: int) -> None:
        """The sink of foreachBatch; batch must hold one row per key."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # numbers of buckets
        new = upsert(self._read(self._paths(number, touched)), batch, self.keys, self.keep, self.add)
        placed = new.withColumn("_bucket", bucket).withColumn("_version", F.lit(number + 1))
        placed.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(self.folder)


def counted(events: DataFrame, at: str, keys: list[str], window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by time window and keys; what is later than `late` is dropped, and windows leave once they are complete."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def unseen(urls: DataFrame, keys: list[str], at: str | None = None, within: str = "1 day") -> DataFrame:
    """Each key once; with a time column only within a watermark, so that the state stays bounded."""
    return urls.dropDuplicates(keys) if at is None else urls.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


class Barrier(StatefulProcessor):
    """Counts the results of a document's batches; a message counts once, and the last or a hopeless one says what happens next."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "succeeded long, failed long, batches long, said string")
        self.seen = handle.getMapState("seen", "message_id string", "one boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        ok, bad, n, said = self.sums.get() if self.sums.exists() else (0, 0, 0, "")
        states = []
        for frame in rows:
            for r in frame.sort_values("message_id").itertuples():
                if self.seen.containsKey((r.message_id,)):
                    continue
                self.seen.updateValue((r.message_id,), (True,))
                ok, bad, n = ok + int(r.succeeded), bad + int(r.failed), n + 1
                state = ""
                if n >= r.batches_total:
                    state = "COMPLETE" if ok / r.total_pages >= self.threshold else "FAILED"
                elif (r.total_pages - bad) / r.total_pages < self.threshold:
                    state = "UNREACHABLE"
                if state and state != said:
                    states.append((key[0], ok, bad, state))
                    said = state
        self.sums.update((ok, bad, n, said))
        yield pd.DataFrame(states, columns=["document_id", "succeeded", "failed", "state"])

    def close(self) -> None:
        pass


def barrier(results: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(document_id, succeeded, failed, state) when a document's batches (message_id, succeeded, failed, batches_total, total_pages) are done or hopeless."""
    return results.groupBy("document_id").transformWithStateInPandas(Barrier(threshold), "document_id string, succeeded long, failed long, state string", "Append", "None")


class Quota(StatefulProcessor):
    """Calls of one user and day up to a limit; with `days` the count is forgotten after so many."""

    def __init__(self, limit: int, days: int | None):
        self.limit, self.days = limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long", ttlDurationMs=self.days * 86_400_000) if self.days else handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        n = self.used.get()[0] if self.used.exists() else 0
        out = []
        for call in sorted(c for frame in rows for c in frame["call_id"].tolist()):
            out.append((key[0], call, n < self.limit))
            n = min(n + 1, self.limit)
        self.used.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "call_id", "admitted"])

    def close(self) -> None:
        pass


def quotas(calls: DataFrame, limit: int, days: int | None = None) -> DataFrame:
    """(user_id, call_id, admitted) of calls (user_id, day, call_id): the first `limit` of each user and day.

    `days` (QUOTA_DAYS) is for queries that run on: state with an age needs processing time, under which a drained query does not end.
    """
    return calls.groupBy("user_id", "day").transformWithStateInPandas(Quota(limit, days), "user_id string, call_id long, admitted boolean", "Append", "ProcessingTime" if days else "None")


def spoken(words: DataFrame, size: int = 30, late: str = "1 hour") -> DataFrame:
    """(media, segment_index, text, word_count, speaker) of words (media, id, start, word, speaker), start in seconds: each window anew whenever words have come for it.

    A window's words are joined in the order of their starts and ids; its speaker is who says most of them, of several who speaks first. Words that come when
    their medium's clock is `late` further are dropped, and windows leave the state. Runs in update mode: a sink keeps the last row of each window.
    """
    rows = words.where("start is not null").withColumn("at", F.timestamp_seconds("start")).withWatermark("at", late)
    every = F.array_sort(F.collect_list(F.struct("start", "id", "word", "speaker"))).alias("w")
    said = rows.groupBy("media", F.window("at", f"{size} seconds").alias("t")).agg(every)
    speakers = F.transform(F.filter("w", lambda x: x["speaker"].isNotNull()), lambda x: x["speaker"])
    counts = F.transform(F.array_distinct("s"), lambda x: F.struct((-F.size(F.filter("s", lambda y: y == x))).alias("n"), F.array_position("s", x).alias("first"), x.alias("speaker")))
    out = said.withColumn("s", speakers).withColumn("_best", F.array_min(counts))
    index = F.floor(F.unix_seconds(F.col("t.start")) / size).alias("segment_index")
    return out.select("media", index, F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.size("w").cast("long").alias("word_count"), F.col("_best.speaker").alias("speaker"))


class Transcripts:
    """The windows of spoken() by micro-batch below a folder, and the index rows of all media from the last row of each window."""

    def __init__(self, spark: SparkSession, folder: str, size: int = 30):
        self.spark, self.folder, self.size = spark, folder, size

    def take(self, words: DataFrame, late: str = "1 hour") -> None:
        """Takes what has arrived; a micro-batch that is repeated replaces its rows."""
        drained(spoken(words, self.size, late), f"{self.folder}/cursor", lambda batch, n: batch.write.mode("overwrite").parquet(f"{self.folder}/windows/batch={n}"), "update")

    def segments(self) -> DataFrame:
        """(media, segment_index, timestamp_start, timestamp_end, text, word_count, speaker, uri) up to each medium's last word, silent windows too."""
        rows = self.spark.read.option("basePath", f"{self.folder}/windows").parquet(f"{self.folder}/windows/batch=*")
        last = rows.groupBy("media", "segment_index").agg(F.max_by(F.struct("text", "word_count", "speaker"), "batch").alias("x")).select("media", "segment_index", "x.*")
        every = last.groupBy("media").agg(F.max("segment_index").alias("n")).select("media", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("segment_index"))
        out = every.join(last, ["media", "segment_index"], "left")
        uri = F.concat(F.lit("content/"), F.col("media").cast("string"), F.lit("/segment-"), F.lpad(F.col("segment_index").cast("string"), 3, "0"), F.lit(".txt"))
        return out.select("media", "segment_index", (F.col("segment_index") * self.size).alias("timestamp_start"), ((F.col("segment_index") + 1) * self.size).alias("timestamp_end"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("word_count", F.lit(0)).cast("long").alias("word_count"), "speaker", uri.alias("uri"))
