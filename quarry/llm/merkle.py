"""Merkle manifest of a data set: leaves, subroots per group, one root, and a proof for each row by lookups of coordinates.

Each row is a leaf, the digest of its fields. Per group the leaves are put in the order of their key;
runs of `fan` consecutive nodes become one node until one is left, the subroot; the subroots, in the
order of their groups, become the root by the same law. Nodes lie in a table under their coordinates (tree, level, place).

A leaf's proof needs the nodes beside it on each level. Their coordinates follow from the place of the leaf and the
width of the level alone, so leaves explode the coordinates they need, join the node table, put what they found in order,
concatenate and fold. Upper nodes are needed by all leaves below them; so that no node is
asked for by more than fan ** depth rows, trees are cut into tiers of `depth` levels: a row explodes
the coordinates of its own tier, and the proof of its tier's top, found once a top, is handed down over a join on the top's place.

Leaves get their places without a window over a group: rows are dealt into ranges of (group, key, leaf), numbered in each range, and the counts of
the ranges (as many as there are shuffle partitions) are added up. Each tier is one shuffle, so a group of n rows takes log(n) / log(fan ** depth) of them. No text is shuffled.

Defined results: a null field is `-` and an empty one `0:`; texts of any length are taken whole; a null group is a group, the first;
null keys come first; rows with equal keys are ordered by their leaves, so that equal rows have equal leaves and proofs of their own; a lone
leaf is its group's subroot, a lone subroot the root; without siblings proof_sha256 is the digest of nothing. An empty table gives an empty
table. Only the named columns are read; other columns, whatever their names, are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32, CRC32_SQL, kept

FAN, DEPTH = 2, 12
#: Levels that a tree can have: 2 ** 62 leaves.
MOST_LEVELS = 63
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 in lower-case hex of the parts behind one another."""
    return F.sha2(F.concat(*parts), 256)


def framed(field: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(df: DataFrame, fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return digest(*(framed(changed.get(f, df[f])) for f in fields))


def power(fan: int, levels: Column) -> Column:
    """fan ** levels as a long."""
    return F.element_at(F.array(*(F.lit(fan**k).cast("long") for k in range(MOST_LEVELS) if fan**k < 2**63)), levels + 1)


def ancestor(i: Column, levels: Column, fan: int) -> Column:
    """The place of the node `levels` above place i."""
    return F.call_function("div", i, power(fan, levels))


def placed(rows: DataFrame, tree: Column, key: Column) -> DataFrame:
    """rows(h, ...) with tree, i (place in the tree from 0, in the order of key and h) and n (nodes of the tree)."""
    ranged = rows.withColumn("tree", tree).withColumn("_key", key).repartitionByRange("tree", "_key", "h").withColumn("_range", F.spark_partition_id())
    ranged = kept(ranged, "leaves")
    counts = kept(ranged.groupBy("tree", "_range").agg(F.count("*").alias("c")), "ranges")
    of_tree = Window.partitionBy("tree")
    before = counts.select("tree", "_range", (F.sum("c").over(of_tree.orderBy("_range")) - F.col("c")).alias("_before"), F.sum("c").over(of_tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(F.col("_key").asc_nulls_first(), "h")) - 1
    numbered = ranged.withColumn("i", own)
    same = numbered["tree"].eqNullSafe(before["tree"]) & (numbered["_range"] == before["_range"])
    return numbered.join(before, same).select(*(numbered[c] for c in rows.columns), numbered["tree"], (numbered["i"] + before["_before"]).cast("long").alias("i"), before["n"])


def depth_of(n: Column, fan: int) -> Column:
    """Levels above n leaves: the times that n is divided by fan, rounding up, until it is 1."""
    return F.size(F.filter(F.array(*(F.lit(fan**k).cast("long") for k in range(MOST_LEVELS) if fan**k < 2**63)), lambda p: p < n))


def width_at(n: Column, level: Column, fan: int) -> Column:
    """Nodes on a level of a tree with n leaves."""
    return ancestor(n - 1, level, fan) + 1


def tier(base: DataFrame, start: int, fan: int, depth: int) -> DataFrame:
    """(tree, n, level, i, h): all nodes of the levels start to start + depth over the nodes base(tree, n, i, h) of level start.

    A group holds fan ** depth nodes at most.
    """
    up = lambda a: F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(a) - 1, F.lit(fan)).cast("int")), lambda k: F.sha2(F.array_join(F.slice(a, k * fan + 1, F.lit(fan)), ""), 256))
    runs = base.withColumn("top", ancestor(F.col("i"), F.lit(depth), fan)).groupBy("tree", "n", "top").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run"))
    first, steps = F.array(F.transform("run", lambda x: x["h"])), F.least(F.lit(depth), depth_of(F.col("n"), fan) - start)
    every = F.when(steps <= 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), first, lambda a, _: F.concat(a, F.array(up(F.element_at(a, -1))))))
    level = runs.select("tree", "n", "top", F.posexplode(every).alias("step", "hs"))
    node = level.select("tree", "n", "top", "step", F.posexplode("hs").alias("k", "h"))
    return node.select("tree", "n", (F.col("step") + start).alias("level"), (F.col("top") * power(fan, depth - F.col("step")) + F.col("k")).alias("i"), "h")


def nodes(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """The node tables of the tiers over leaves(tree, i, n, h), from the bottom to the roots; each a written table."""
    most = leaves.agg(F.max(depth_of(F.col("n"), fan))).first()[0]
    tiers, base = [], leaves
    for start in range(0, max(1, most or 0), depth):
        tiers.append(kept(tier(base.select("tree", "n", "i", "h"), start, fan, depth), "nodes"))
        base = tiers[-1].where((F.col("level") == start + depth) & (depth_of(F.col("n"), fan) > start + depth))
    return tiers


def sides(asking: DataFrame, table: DataFrame, start: int, fan: int, depth: int) -> DataFrame:
    """(tree, i, sides) of asking(tree, n, i): the (level, at, h) of all siblings on the levels start to start + depth - 1, looked up by their coordinates."""
    levels = F.least(F.lit(start + depth), depth_of(F.col("n"), fan)) - 1
    at = asking.select("tree", "n", "i").where(levels >= start).select("*", F.explode(F.sequence(F.lit(start), F.greatest(levels, F.lit(start)))).alias("level"))
    at = at.withColumn("own", ancestor(F.col("i"), F.col("level") - start, fan))
    first = F.call_function("div", F.col("own"), F.lit(fan)) * fan
    last = F.least(first + fan, width_at(F.col("n"), F.col("level"), fan)) - 1
    at = at.select("tree", "i", "level", "own", F.explode(F.sequence(first, last)).alias("at")).where("at <> own")
    node = table.select(F.col("tree").alias("_t"), F.col("level").alias("_l"), F.col("i").alias("_i"), F.unhex("h").alias("h"))
    met = at.join(node, at["tree"].eqNullSafe(node["_t"]) & (at["level"] == node["_l"]) & (at["at"] == node["_i"]))
    return met.groupBy("tree", at["i"]).agg(F.collect_list(F.struct("level", "at", "h")).alias("sides"))


def own_places(start: int, fan: int, depth: int) -> Column:
    """The row's own (level, at, null) on the levels start to start + depth - 1."""
    levels = F.least(F.lit(start + depth), depth_of(F.col("n"), fan)) - 1
    places = F.transform(F.sequence(F.lit(start), F.greatest(levels, F.lit(start))), lambda k: F.struct(k.alias("level"), ancestor(F.col("i"), k - start, fan).alias("at"), F.lit(None).cast("binary").alias("h")))
    return F.when(levels >= start, places).otherwise(F.array().cast(SIDES))


SIDES = "array<struct<level:int,at:bigint,h:binary>>"


def proven(leaves: DataFrame, tiers: list[DataFrame], above: DataFrame | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """leaves with subroot and path: per tier, from the leaf to the root of its tree and of the trees above, its sides and own places in order.

    above(tree, path, ...) are the paths from the roots on, and further columns that are handed down.
    """
    levels = depth_of(F.col("n"), fan)
    roots = reduce(DataFrame.unionByName, tiers).where(F.col("level") == levels).select("tree", F.col("i"), F.col("h").alias("subroot"), levels.alias("levels"))
    if above is None:
        roots = roots.withColumn("path", F.array().cast(f"array<{SIDES}>"))
    else:
        roots = roots.join(above.withColumnRenamed("tree", "_t"), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    roots, down = kept(roots, "roots"), None
    for k in range(len(tiers) - 1, -1, -1):
        start = k * depth
        asking = leaves if k == 0 else tiers[k].where(F.col("level") == start).select("tree", "n", "i")
        found = sides(asking, tiers[k], start, fan, depth).withColumnRenamed("tree", "_t").withColumnRenamed("i", "_i")
        rows = asking.join(found, asking["tree"].eqNullSafe(F.col("_t")) & (asking["i"] == F.col("_i")), "left").drop("_t", "_i")
        tops = roots.where((F.col("levels") <= start + depth) & ((F.col("levels") > start) | F.lit(k == 0))).drop("levels")
        tops = (tops if down is None else tops.unionByName(down)).withColumnRenamed("tree", "_t").withColumnRenamed("i", "_i").withColumnRenamed("path", "_path")
        rows = rows.join(tops, rows["tree"].eqNullSafe(F.col("_t")) & (ancestor(rows["i"], F.lit(depth), fan) == F.col("_i"))).drop("_t", "_i")
        step = F.array_sort(F.concat(F.coalesce("sides", F.array().cast(SIDES)), own_places(start, fan, depth)))
        down = rows.withColumn("path", F.concat(F.array(step), "_path")).drop("sides", "_path")
        if k:
            down = kept(down.drop("n"), "handed")
    return down


def folded(path: str, start: Column) -> Column:
    """The digest at the end of a path that begins with `start`."""

    def tier_(acc: Column, sides: Column) -> Column:
        def side(s: Column, x: Column) -> Column:
            done = s["level"] != x["level"]  # the run of the level below is whole
            own = F.when(done & (s["level"] >= 0), F.sha2(s["run"], 256)).otherwise(s["own"])
            return F.struct(x["level"].alias("level"), own.alias("own"), F.concat(F.when(done, F.lit("")).otherwise(s["run"]), F.coalesce(F.lower(F.hex(x["h"])), own)).alias("run"))

        zero = F.struct(F.lit(-1).alias("level"), acc.alias("own"), F.lit("").alias("run"))
        return F.aggregate(sides, zero, side, lambda s: F.when(s["level"] >= 0, F.sha2(s["run"], 256)).otherwise(s["own"]))

    return F.aggregate(path, start, tier_)


def siblings(path: str) -> Column:
    """The digest of all siblings on a path, in hex, from the leaf upwards and from left to right."""
    return F.sha2(F.array_join(F.transform(F.filter(F.flatten(path), lambda x: x["h"].isNotNull()), lambda x: F.lower(F.hex(x["h"]))), ""), 256)


def manifest(rows: DataFrame, key: str, group: str, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """rows(h, key, group, ...) with subroot, root and path; h is the leaf. key is an integer, group a string; result columns replace those of the same name."""
    rows = rows.drop("tree", "i", "n", "subroot", "root", "path")
    leaves = kept(placed(rows, F.col(group), F.col(key)), "placed")
    tiers = nodes(leaves, fan, depth)
    roots = reduce(DataFrame.unionByName, tiers).where(F.col("level") == depth_of(F.col("n"), fan)).select(F.col("tree").alias("g"), "h")
    upper = kept(placed(roots, F.lit("").alias("tree"), F.col("g")), "subroots")
    above = proven(upper, nodes(upper, fan, depth), None, fan, depth).withColumnRenamed("subroot", "root")
    above = kept(above.select(F.col("g").alias("tree"), "path", "root"), "above")
    return proven(leaves, tiers, above, fan, depth).drop("tree", "i", "n")


def verified(df: DataFrame, tampered: Column | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of documents; `tampered` is a row's changed leaf where it is not null."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), leaf(df).alias("h"), (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    out = manifest(rows, "doc_id", "lang", fan, depth)
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", siblings("path").alias("proof_sha256"), folded("path", F.coalesce("other", "h")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return verified(df, F.when(hit & F.col("n_chars").isNotNull(), leaf(df, n_chars=F.col("n_chars") + 1)))


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
OP13_SQL = f"""
WITH RECURSIVE {CRC32_SQL}, hashed AS (
  SELECT *, {_LEAF} AS leaf, {CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents, remainders
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, leaf, CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE leaf END AS now,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), nodes AS (
  SELECT lang, 0 AS level, i, leaf AS h FROM leaves
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS w FROM nodes) WHERE w > 1 GROUP BY lang, level, i // 2
), subs AS MATERIALIZED (
  SELECT lang, max(level) AS depth, max_by(h, level) AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS j FROM nodes GROUP BY lang
), tops AS (
  SELECT 0 AS level, j AS i, subroot AS h FROM subs
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS w FROM tops) WHERE w > 1 GROUP BY level, i // 2
), below AS (
  SELECT lang, i AS leaf_at, 0 AS level, i, now AS acc, '' AS beside FROM leaves
  UNION ALL SELECT b.lang, leaf_at, b.level + 1, b.i // 2, sha256(CASE WHEN b.i % 2 = 0 THEN acc || coalesce(n.h, '') ELSE coalesce(n.h, '') || acc END), beside || coalesce(n.h, '')
  FROM below b JOIN subs s ON b.lang IS NOT DISTINCT FROM s.lang AND b.level < s.depth LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM b.lang AND n.level = b.level AND n.i = xor(b.i, 1)
), above AS (
  SELECT b.lang, leaf_at, 0 AS level, j AS i, acc, beside FROM below b JOIN subs s ON b.lang IS NOT DISTINCT FROM s.lang AND b.level = s.depth
  UNION ALL SELECT a.lang, leaf_at, a.level + 1, a.i // 2, sha256(CASE WHEN a.i % 2 = 0 THEN acc || coalesce(t.h, '') ELSE coalesce(t.h, '') || acc END), beside || coalesce(t.h, '')
  FROM above a LEFT JOIN tops t ON t.level = a.level AND t.i = xor(a.i, 1) WHERE a.level < (SELECT max(level) FROM tops)
)
SELECT doc_id, l.leaf, subroot, root, sha256(beside) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaves l JOIN above a ON l.lang IS NOT DISTINCT FROM a.lang AND l.i = a.leaf_at AND a.level = (SELECT max(level) FROM tops)
JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang, (SELECT max_by(h, level) AS root FROM tops)
"""
