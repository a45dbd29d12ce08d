"""Progress thresholds and quotas, as batch replays of their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = 0.95
FAILURES = 0.1


def batches(events: DataFrame, document: str, order: list[str], succeeded: str, failed: str, threshold: float = SUCCESS) -> DataFrame:
    """Each batch result with the sums so far, the batches left, and whether the threshold can still be reached.

    state is COMPLETE or FAILED at the last batch, UNREACHABLE before it, else RUNNING.
    """
    whole = Window.partitionBy(document)
    sofar = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = events.withColumns({
        "pages_succeeded": F.sum(succeeded).over(sofar),
        "pages_failed": F.sum(failed).over(sofar),
        "remaining": F.count("*").over(whole) - F.count("*").over(sofar),
        "_total": F.sum(F.col(succeeded) + F.col(failed)).over(whole),
    })
    done = F.col("pages_succeeded") / F.col("_total") >= threshold
    reach = (F.col("_total") - F.col("pages_failed")) / F.col("_total") >= threshold
    state = F.when(F.col("remaining") == 0, F.when(done, "COMPLETE").otherwise("FAILED")).when(~reach, "UNREACHABLE").otherwise("RUNNING")
    return out.withColumn("can_reach", reach).withColumn("state", state).drop("_total")


def crawl(pages: DataFrame, job: str, status: str, queued: Column | None = None) -> DataFrame:
    """Per crawl job: total, processed, failed, pending, percent (half to even), and whether it is complete or has failed too often."""
    out = pages.groupBy(job).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status).isin("COMPLETED", "SKIPPED")).alias("processed"),
        F.count_if(F.col(status) == "FAILED").alias("failed"),
        F.coalesce(F.bool_or(queued), F.lit(False)).alias("_queued") if queued is not None else F.lit(False).alias("_queued"),
    )
    handled = F.col("processed") + F.col("failed")
    return out.withColumns({
        "pending": F.greatest(F.lit(0), F.col("total") - handled).cast("long"),
        "percent": F.bround(handled / F.col("total") * 100, 1),
        "too_many_failures": F.when(handled > 0, F.col("failed") / handled > FAILURES).otherwise(False),
        "complete": ~F.col("_queued") & (handled >= F.col("total")) & (F.col("total") > 0),
    }).drop("_queued")


def quota(calls: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Calls with used (calls of the key so far), admitted and remaining."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = calls.withColumn("used", n)
    return out.withColumn("admitted", F.col("used") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def coupled_quota(calls: DataFrame, user: str, day: str, order: list[str], user_limit: int, global_limit: int) -> DataFrame:
    """Calls with admitted, where a call counts for its user and for all users, or, if either is at its limit, for neither.

    As nothing is admitted any more once the common limit is reached, a user's calls before that are their first ones: a call is admitted
    if it is among its user's first `user_limit` of the day and, among all calls of which this holds, not behind the
    `global_limit`-th. Only that one call per day is looked for, and the search keeps `global_limit` rows of each task.
    """
    mine = F.row_number().over(Window.partitionBy(user, day).orderBy(*order))
    rows = calls.withColumn("_mine", mine).withColumn("_at", F.struct(*order))
    eligible = rows.where(F.col("_mine") <= user_limit)
    k = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    last = eligible.select(day, *order, "_at").withColumn("_k", k).where(F.col("_k") <= global_limit).groupBy(day).agg(F.max("_at").alias("_last"))
    out = rows.join(last, day, "left")
    return out.withColumn("admitted", F.coalesce((F.col("_mine") <= user_limit) & (F.col("_at") <= F.col("_last")), F.lit(False))).drop("_mine", "_at", "_last")
