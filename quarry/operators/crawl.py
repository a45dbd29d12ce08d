"""Crawl frontier over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import checkpointed


def link_graph(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, pos): the normalised links of each page in order."""
    found = pages.where(F.col(html).isNotNull()).select(F.col(url).alias("_u"), F.posexplode(U.links(F.col(html))).alias("pos", "_l"))
    dst = U.absolute(F.col("_l"), F.col("_u"))
    return found.select(U.crawl_form(F.col("_u")).alias("src"), U.crawl_form(dst).alias("dst"), "pos").where(U.scheme(F.col("dst")).isin("http", "https"))


def frontier(links: DataFrame, seeds: DataFrame, allowed: Column | None = None, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of pages reached from seeds(url) in breadth-first order, each once at its least depth.

    A step per depth: a join with the links, a distinct, an anti-join with what is visited. Each step is checkpointed, so that
    plans stay small and a lost executor costs one step. The page budget takes shallower pages first, then by url.
    """
    graph = checkpointed((links if allowed is None else links.where(allowed)).select("src", "dst").distinct())  # read once a depth, made once
    visited = checkpointed(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    newest = visited
    for depth in range(1, max_depth + 1):
        found = newest.join(graph, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(visited, "url", "left_anti")
        newest = checkpointed(found.withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        visited = visited.union(newest)
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)


def unvisited(found: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(visited.select(*keys).distinct(), keys, "left_anti")


def is_scripted(html: Column) -> Column:
    """Whether a page seems to be built by scripts: two of seven signs."""
    text = F.length(F.trim(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")))
    scripts = F.regexp_count(html, F.lit("(?i)<script"))
    has = lambda s: F.contains(html, F.lit(s))
    signs = [text < 500, scripts > 5, has("__NEXT_DATA__"), has("window.__NUXT__"), has("ng-app"), has("data-reactroot") & (text < 1000), has('id="__next"') & (text < 1000)]
    total = signs[0].cast("int")
    for s in signs[1:]:
        total = total + s.cast("int")
    return total >= 2


def rendered(http: Column, browser: Column) -> Column:
    """The rendered page where a plain one seems scripted and there is a rendered one."""
    return F.when(is_scripted(http), F.coalesce(browser, http)).otherwise(http)
