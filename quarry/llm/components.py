"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v) that has a link; root is the smallest node of its component.

    Each round halves the depth at least; a round's edges are written to the
    shared folder, and only a count and a checksum come to the driver. Nodes with many links
    are met by partial aggregation and by joins that AQE can split.
    """
    e = edges.select("u", "v").where("u <> v")
    e = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        # large star: larger neighbours of a node point to the smallest node around it
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        j = e.join(least, "u")
        e = kept(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
