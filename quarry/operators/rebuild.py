"""A rebuild of the whole index that can be broken off at any place and taken up again.

folder/lock holds the name of the run that may write: it is created only if it is not there, so of several runs one begins. Documents go in
waves, ranges of ids that the scan prunes by. A wave's chunks are written first and its tallies after them; with the tallies it
is done and is never done again, without them it is done anew and replaces what it had written. When all waves are done, folder/current
names the run in one step, so that readers see the old index or the whole new one; then the old run goes, and the lock.

Defined results: documents without an id are in the first wave and no batch; an empty table gives a run without rows. A run that failed keeps
its lock until it is resumed under its name or dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import flows

BATCH, WAVES = 10, 16


class Busy(ValueError):
    """Another run holds the lock."""


def holder(spark: SparkSession, folder: str) -> str | None:
    """The run that holds the lock."""
    return store.read(spark, f"{folder}/lock")


def acquired(spark: SparkSession, folder: str, run: str) -> bool:
    """Takes the lock for a run; it is the run's own when it is resumed."""
    return store.created(spark, f"{folder}/lock", run) or holder(spark, folder) == run


def released(spark: SparkSession, folder: str, run: str) -> bool:
    """Gives the lock back; a lock of another run stays."""
    return holder(spark, folder) == run and store.removed(spark, f"{folder}/lock")


def guarded(spark: SparkSession, folder: str) -> None:
    """Raises Busy while a rebuild runs: for what must not change the catalogue under it."""
    if (run := holder(spark, folder)) is not None:
        raise Busy(f"The index is being rebuilt by {run}")


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The finished index: (document_id, chunk, text) and the wave; None before the first run."""
    run = store.read(spark, f"{folder}/current")
    return None if run is None else spark.read.parquet(f"{folder}/{run}/index")


def tallies(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """(batch, processed_count, error_count, last_errors, wave) of the waves of a run that are done."""
    return spark.read.parquet(f"{folder}/{run}/ledger")


def bounds(content: DataFrame, waves: int, batch: int) -> list[tuple[int | None, int | None]]:
    """First id and end of each wave: equal ranges of whole batches; one row comes to the driver."""
    low, high = content.agg(F.min("document_id"), F.max("document_id")).first()
    if low is None:
        return [(None, None)]
    first, last = low // batch, high // batch
    size = max(1, -(-(last - first + 1) // waves))
    return [(k * batch, (k + size) * batch) for k in range(first, last + 1, size)]


def run(folder: str, name: str, content: DataFrame, texts: DataFrame, waves: int = WAVES, batch: int = BATCH, after: Callable[[int], None] | None = None) -> DataFrame:
    """A new index of content (document_id, filename, type) with texts (document_id, text), or the rest of a run that was broken off; the tallies of its batches.

    after(wave) is called once a wave is done. The number of waves of a run is that of its beginning.
    """
    spark = content.sparkSession
    if not acquired(spark, folder, name):
        raise Busy(f"The index is being rebuilt by {holder(spark, folder)}")
    if store.read(spark, f"{folder}/current") == name:  # it ended after it had published
        released(spark, folder, name)
        return tallies(spark, folder, name)
    plan = f"{folder}/{name}.plan"
    store.created(spark, plan, "\n".join(f"{a} {b}" for a, b in bounds(content, waves, batch)))
    ranges = [line.split() for line in store.read(spark, plan).split("\n")]
    for wave, (low, high) in enumerate(ranges):
        ledger = f"{folder}/{name}/ledger/wave={wave}"
        if store.exists(spark, f"{ledger}/_SUCCESS"):
            continue
        of = F.lit(True) if low == "None" else (F.col("document_id") >= int(low)) & (F.col("document_id") < int(high))
        mine = content.where(of | F.col("document_id").isNull() if wave == 0 else of)
        chunks, counts = flows.rebuilt(mine, texts.where(of), batch)
        chunks.write.mode("overwrite").parquet(f"{folder}/{name}/index/wave={wave}")
        counts.write.mode("overwrite").parquet(ledger)
        if after:
            after(wave)
    return finished(spark, folder, name)


def finished(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Publishes a run, removes the one before it and gives the lock back."""
    old = store.read(spark, f"{folder}/current")
    store.replaced(spark, f"{folder}/current", name)
    if old and old != name:
        store.removed(spark, f"{folder}/{old}")
        store.removed(spark, f"{folder}/{old}.plan")
    released(spark, folder, name)
    return tallies(spark, folder, name)


def dropped(spark: SparkSession, folder: str, name: str) -> None:
    """Removes a run that failed and its lock; what is published stays."""
    if store.read(spark, f"{folder}/current") == name:
        raise ValueError("the run is published")
    store.removed(spark, f"{folder}/{name}")
    store.removed(spark, f"{folder}/{name}.plan")
    released(spark, folder, name)
