"""A message queue in a shared folder: batches of a few messages, failures that come again, dead letters.

Messages lie in Parquet files of at most `size` rows, and a stream takes `batches` files at a time, so that a micro-batch is `batches` consumers with `size` messages each.
A handler says for each message whether it failed. What failed is sent again with one receipt more, at most `most` times, and then goes
to the dead letters; the other messages of its batch are done. Files are named after the micro-batch they come from,
so that a batch that is repeated after a loss replaces what it had written: a message may be handled twice (at least once), and is counted once.

Defined results: a handler's rows with a null error are done; a message that the handler drops has failed; an empty queue gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from .jobs import drained, files

SIZE, BATCHES, MOST = 10, 4, 3
SCHEMA = "message_id string, body string, receives int"
DONE = "message_id string, body string, receives int, error string"


class Queue:
    """folder/in, folder/done and folder/dead hold the messages; folder/cursor is the checkpoint of the stream."""

    def __init__(self, spark: SparkSession, folder: str, size: int = SIZE, batches: int = BATCHES, most: int = MOST):
        self.spark, self.folder, self.size, self.batches, self.most = spark, folder.rstrip("/"), size, batches, most

    def send(self, messages: DataFrame, name: str) -> None:
        """Messages (message_id, body) under a name; the same name replaces them as long as they are not taken."""
        rows = messages.select("message_id", "body", F.lit(0).alias("receives"))
        self._put(rows, f"in/{name}")

    def _put(self, rows: DataFrame, where: str) -> None:
        rows.write.mode("overwrite").option("maxRecordsPerFile", self.size).parquet(f"{self.folder}/{where}")

    def consume(self, handler: Callable[[DataFrame], DataFrame]) -> int:
        """Handles all that is there, and what fails until it is done or dead; handler(messages) returns message_id and error. The micro-batches it took."""
        taken = []

        def each(batch: DataFrame, number: int) -> None:
            said = handler(batch).select("message_id", F.col("error").cast("string").alias("error"), F.lit(True).alias("_said"))
            error = F.when(F.col("_said").isNull(), F.lit("no answer")).otherwise(F.col("error"))
            # a micro-batch is small by its bounds: its answers go to its tasks, without a shuffle
            out = batch.join(F.broadcast(said), "message_id", "left").select("message_id", "body", (F.col("receives") + 1).alias("receives"), error.alias("error")).persist()
            try:
                again = out.where((F.col("receives") < self.most) & F.col("error").isNotNull())
                out.where("error is null").write.mode("overwrite").parquet(f"{self.folder}/done/batch={number}")
                out.where((F.col("receives") >= self.most) & F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{self.folder}/dead/batch={number}")
                if again.take(1):
                    self._put(again.select("message_id", "body", "receives"), f"in/again-{number}")
            finally:
                out.unpersist()
            taken.append(number)

        before = -1
        while len(taken) > before:  # what was sent again is found by the next look at the folder
            before = len(taken)
            if not store.listed(self.spark, f"{self.folder}/in"):
                break
            stream = files(self.spark, f"{self.folder}/in/*", SCHEMA, per_batch=self.batches)
            drained(stream, f"{self.folder}/cursor", each)
        return len(taken)

    def _read(self, what: str) -> DataFrame:
        if not store.listed(self.spark, f"{self.folder}/{what}"):
            return self.spark.createDataFrame([], DONE)
        return self.spark.read.schema(DONE).parquet(f"{self.folder}/{what}/batch=*")

    def done(self) -> DataFrame:
        """(message_id, body, receives, error): what was handled."""
        return self._read("done")

    def dead(self) -> DataFrame:
        """The messages that failed for the last time."""
        return self._read("dead")


#: Extensions of media that are taken up when they arrive.
VIDEO, AUDIO = ["mp4", "webm"], ["mp3", "wav", "m4a", "ogg"]


def object_events(events: DataFrame, detail: str = "detail") -> DataFrame:
    """(document_id, filename, input_uri, output_prefix, media_type) of events that say that a media file was created as content/<document>/.../<file>; all others go.

    `detail` is JSON with bucket.name and object.key; what is no such JSON is no such event.
    """
    d = F.from_json(detail, "bucket struct<name: string>, object struct<key: string>")
    rows = events.select(d["bucket"]["name"].alias("bucket"), d["object"]["key"].alias("key")).where("bucket <> '' and key like 'content/%/%'")
    parts = F.split("key", "/")
    name = F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"[.]([^.]*)$", 1))
    kind = F.when(extension.isin(VIDEO), "video").when(extension.isin(AUDIO), "audio")
    uri = lambda *x: F.concat(F.lit("s3://"), "bucket", F.lit("/"), *x)
    out = rows.select(parts[1].alias("document_id"), name.alias("filename"), uri("key").alias("input_uri"), uri(F.lit("content/"), parts[1], F.lit("/")).alias("output_prefix"), kind.alias("media_type"))
    return out.where("media_type is not null")
