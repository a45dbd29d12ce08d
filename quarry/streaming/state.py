"""State with an age and jobs with a life, as processors of Structured Streaming.

Both take rows in the order of their event time and id within a micro-batch; what comes later than the watermark allows is dropped by the stream. All state is of one
key, bounded and in the state store, so a lost executor goes on from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


class Aged(StatefulProcessor):
    """A count of each key that is forgotten `age` milliseconds after its last row, by event-time timers, so that drained streams forget too."""

    def __init__(self, limit: int, age: int):
        self.limit, self.age = limit, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "first long, n long, admitted long, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = sorted((int(at), int(i)) for frame in rows for at, i in zip(frame["at_ms"], frame["id"], strict=True))
        first, n, admitted, expires = self.state.get() or (None, 0, 0, None)  # a call a key: each is a round trip to the state's server
        old, out = expires, []
        for at, _ in calls:
            if expires is not None and at >= expires:  # the state was too old, though no timer has come yet
                out.append((*map(str, key), first, n, admitted, expires))
                first, n, admitted = None, 0, 0
            first = at if first is None else first
            n, admitted, expires = n + 1, admitted + (admitted < self.limit), max(expires or 0, at + self.age)
        if expires != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(expires)
        self.state.update((first, n, admitted, expires))
        if out:  # a frame is a batch to Spark, and most keys have nothing to say
            yield pd.DataFrame(out, columns=["key", "first_ms", "n", "admitted", "expired_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if held := self.state.get():
            first, n, admitted, expires = held
            self.state.clear()
            yield pd.DataFrame([(*map(str, key), first, n, admitted, expires)], columns=["key", "first_ms", "n", "admitted", "expired_ms"])

    def close(self) -> None:
        pass


def expiring(calls: DataFrame, limit: int, age_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, first_ms, n, admitted, expired_ms) of each state of calls (key string, id, ts) once it is too old: its first call, its calls, those within the limit."""
    rows = calls.withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", late).select("key", "ts", "id", "at_ms")
    return rows.groupBy("key").transformWithStateInPandas(Aged(limit, age_ms), "key string, first_ms long, n long, admitted long, expired_ms long", "Append", "EventTime")


#: The states of a crawl job; those that can be cancelled; the share of failures from which a finished job has failed.
PENDING, DISCOVERING, PROCESSING, COMPLETED, WITH_ERRORS, FAILED, CANCELLED = "PENDING DISCOVERING PROCESSING COMPLETED COMPLETED_WITH_ERRORS FAILED CANCELLED".split()
OPEN = (PENDING, DISCOVERING, PROCESSING)
FAILURES = 0.1


class Life(StatefulProcessor):
    """A crawl job between its requests and its pages: start and rollback, pages found and done, cancelling, the end."""

    def __init__(self, failures: float):
        self.failures = failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, total long, processed long, failed long, refused long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, total, processed, failed, refused = self.state.get() if self.state.exists() else (None, 0, 0, 0, 0)
        said, out = status, []
        for at, i, kind in sorted((int(a), int(i), str(k)) for frame in rows for a, i, k in zip(frame["at_ms"], frame["id"], frame["kind"], strict=True)):
            if kind == "start":
                if status in OPEN:
                    refused += 1  # it runs already
                else:
                    status, total, processed, failed = PENDING, 0, 0, 0
            elif kind == "cancel_all":  # no answer is owed to jobs that do not run
                status = CANCELLED if status in OPEN else status
            elif kind == "cancel":
                if status in OPEN:
                    status = CANCELLED
                else:
                    refused += 1
            elif status not in OPEN:
                continue  # pages of a job that is over, or was never begun
            elif kind == "broken":  # what should have begun the work failed: the start is taken back
                status = FAILED if status == PENDING else status
            elif kind == "found":
                status, total = DISCOVERING if status == PENDING else status, total + 1
            elif kind in ("done", "skipped", "failed"):
                status = PROCESSING
                processed, failed = processed + (kind != "failed"), failed + (kind == "failed")
            elif kind == "drained" and total > 0 and processed + failed >= total:  # nothing is queued any more
                status = FAILED if failed / total > self.failures else WITH_ERRORS if failed else COMPLETED
            if status != said:
                out.append((*map(str, key), at, i, status, total, processed, failed, refused))
                said = status
        self.state.update((status, total, processed, failed, refused))
        yield pd.DataFrame(out, columns=["job_id", "at_ms", "id", "status", "total", "processed", "failed", "refused"])

    def close(self) -> None:
        pass


def lives(requests: DataFrame, pages: DataFrame, failures: float = FAILURES) -> DataFrame:
    """(job_id, at_ms, id, status, total, processed, failed, refused) at each change of a job's status.

    requests (job_id, ts, id, kind) of start, broken, cancel, cancel_all (for_all() sends one to every job) and drained, pages (job_id, ts, id, kind) of
    found, done, skipped and failed; both are streams, and a job's state is one whichever of them its rows come from. Requests to cancel are refused where a job is over.
    """
    columns = [F.col("job_id").cast("string").alias("job_id"), F.unix_millis("ts").alias("at_ms"), F.col("id").cast("long").alias("id"), "kind"]
    both = requests.select(*columns).unionByName(pages.select(*columns))
    return both.groupBy("job_id").transformWithStateInPandas(Life(failures), "job_id string, at_ms long, id long, status string, total long, processed long, failed long, refused long", "Append", "None")


def for_all(requests: DataFrame, jobs: DataFrame, on: str = "owner") -> DataFrame:
    """Requests (owner, ts, id, kind) as one for each job (job_id, owner) of their owner: a stream joined with a table by key."""
    return requests.join(jobs.select("job_id", on), on).select("job_id", "ts", "id", "kind")
