"""Catalogue operators: lookups, latest rows, history, pages, precedence, upserts, cascades, guarded transitions.

Point lookups become joins that AQE may broadcast by size; picks per key are aggregates with map-side combination
(max_by) or row_number, whose limit Spark pushes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE_JOBS = ("PENDING", "DISCOVERING", "PROCESSING")


def looked_up(df: DataFrame, table: DataFrame, on: str | list[str], default: dict[str, object] | None = None) -> DataFrame:
    """df with the table's columns, defaults where there is no row."""
    out = df.join(table, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (default or {}).items()})


def latest(df: DataFrame, key: str | list[str], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key the columns of the row that is last in order of `by`."""
    keys = [key] if isinstance(key, str) else list(key)
    pick = F.max_by(F.struct(*columns), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, *(F.col("_row")[c].alias(c) for c in columns))


def history(turns: DataFrame, conversation: str, turn: str, n: int = 5, done: Column | None = None) -> DataFrame:
    """The newest n turns of each conversation that are not pending."""
    rows = turns if done is None else turns.where(done)
    k = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return rows.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")


def next_turn(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    return turns.groupBy(conversation).agg((F.max(turn) + 1).alias("next_turn"))


def visible(turns: DataFrame, conversation: str, owner: str, me: str) -> DataFrame:
    """Turns of conversations in which no turn belongs to somebody else."""
    own = F.coalesce(F.col(owner) == me, F.lit(True))
    foreign = turns.where(~own).select(conversation).distinct()
    return turns.join(foreign, conversation, "left_anti")


def keyset_page(df: DataFrame, key: str, after: object | None, limit: int) -> DataFrame:
    """The next rows by key behind the last key of the page before; the filter reaches the scan."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(max(1, min(int(limit), 100)))


def batch(df: DataFrame, order: Sequence[str], size: int, number: int) -> DataFrame:
    """Rows number x size and on, `size` of them, of a stable order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def precedence(frames: Sequence[tuple[DataFrame, int]], key: str, created: str) -> DataFrame:
    """Frames with the same columns as one, each key once: the frame with the highest priority wins, then the later one; newest first, missing dates last."""
    tagged = [df.withColumn("_p", F.lit(p)).withColumn("_n", F.lit(i)) for i, (df, p) in enumerate(frames)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_p"), F.desc("_n"), F.desc_nulls_last(created)))
    return every.withColumn("_k", k).where("_k = 1").drop("_k", "_p", "_n").orderBy(F.desc_nulls_last(created), key)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: Sequence[str] = (), add: Sequence[str] = ()) -> DataFrame:
    """The target with the source's rows in it: source values win where they are not null, except `keep` columns
    (first value stays) and `add` columns (summed). Rows unknown to the target are added. One shuffle by the keys."""
    t, s = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        if c in add:
            out.append((F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).alias(c))
        else:
            out.append((F.coalesce(old, new) if c in keep else F.coalesce(new, old)).alias(c))
    return t.join(s, condition, "full").select(*out)


def cascade(children: dict[str, DataFrame], deleted: DataFrame, on: str) -> dict[str, DataFrame]:
    """Each child table without the rows of deleted parents."""
    gone = deleted.select(on).distinct()
    return {name: df.join(gone, on, "left_anti") for name, df in children.items()}


def transition(df: DataFrame, status: str, start: Sequence[str], to: Column | str, when: Column | None = None) -> DataFrame:
    """Rows in one of the start states (for which `when` holds) go to another; the others stay as they are."""
    may = F.col(status).isin(*start) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return df.withColumn(status, F.when(may, F.lit(to) if isinstance(to, str) else to).otherwise(F.col(status)))


def promoted(documents: DataFrame, statuses: DataFrame, uri: Column, status: str = "status", limit: int | None = None) -> DataFrame:
    """Queued documents by the state of their index entry: INDEXED, INGESTION_FAILED or as they were. statuses: (uri, state), the last of a uri's rows."""
    rows = documents.where(F.col(status) == "SYNC_QUEUED")
    rows = rows if limit is None else rows.orderBy("document_id").limit(limit)
    both = rows.withColumn("uri", uri).join(statuses, "uri", "left")
    new = F.when(F.col("state") == "INDEXED", "INDEXED").when(F.col("state").isin("FAILED", "NOT_FOUND"), "INGESTION_FAILED").otherwise(F.col(status))
    return both.withColumn(status, new).drop("uri", "state")


def changed(pages: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Pages whose value differs from the one known for the key, or has none."""
    old = known.select(key, F.col(value).alias("_old"))
    return pages.join(old, key, "left").where(F.col("_old").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old")


def within(created: Column, now: object, days: int | None) -> Column:
    """Created in the last days, or without a date; no days: all."""
    if days is None:
        return F.lit(True)
    return created.isNull() | (created >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def unknown_keys(given: Column, valid: Sequence[str]) -> Column:
    """Keys of a map that a configuration does not have."""
    return F.array_except(F.map_keys(given), F.array(*map(F.lit, valid)))


def may_access(kind: Column, setting: Column) -> Column:
    """Signed-in users and API keys may; others where the setting (by default yes) says so."""
    return kind.isin("user", "api_key") | F.coalesce(setting, F.lit(True))


def citations(results: DataFrame, tracking: DataFrame, on: str, bucket: str) -> DataFrame:
    """Results with the uri to cite: a scraped page's own, else the tracked input, else one made from the document id, else the result's."""
    both = results.join(tracking.select(on, "type", "input_uri"), on, "left")
    made = F.when(F.length(F.col(on).cast("string")) >= 5, F.concat(F.lit(f"s3://{bucket}/input/"), F.col(on).cast("string"), F.lit("/"), F.element_at(F.split("uri", "/"), -1)))
    return both.withColumn("source_uri", F.when(F.col("type") == "scraped", F.col("uri")).otherwise(F.coalesce("input_uri", made, "uri")))


def source_url(sidecar: Column, tracked: Column, front_matter: Column) -> Column:
    """Where a text came from: its sidecar's (first) value, its catalogue row, its front matter."""
    return F.coalesce(F.get(sidecar, F.lit(0)), tracked, front_matter)
