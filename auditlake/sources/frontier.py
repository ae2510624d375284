"""Breadth-first crawl over a table of links, level by level.

A page's depth is its true distance from the start; where the budget of pages ends inside a
level, pages come by their first parent's order. Each level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import is_same_site
from auditlake.storage import materialize

MAX_PAGES, MAX_DEPTH = 200, 5


def settled(df: DataFrame) -> DataFrame:
    return materialize(df, "frontier")


def crawl_order(edges: DataFrame, start: str, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, depth, discovered_from) of the pages reached from start.

    edges: (source_url, target_url, position), followed whether nofollow or not, if on the start's site.
    """
    spark = edges.sparkSession
    links = edges.filter(is_same_site(F.col("target_url"), F.lit(start))).select("source_url", "target_url", "position")
    seen = frontier = settled(spark.createDataFrame([(start, 0, None, 0)],
            "url string, depth int, discovered_from string, ord long"))
    reached = 1
    for depth in range(1, max_depth + 1):
        if reached >= max_pages:
            break
        first = links.join(frontier.select(F.col("url").alias("source_url"), "ord"),
            "source_url").groupBy(F.col("target_url").alias("url")).agg(F.min(F.struct("ord", "position",
                    "source_url")).alias("by"))
        new = settled(first.join(seen.select("url"), "url", "left_anti"))
        n, room = new.count(), max_pages - reached
        new = new.orderBy("by", "url")
        if n > room:
            new = new.limit(room)
        found = new.select("url", F.lit(depth).alias("depth"), F.col("by.source_url").alias("discovered_from"),
            (F.monotonically_increasing_id() + reached).alias("ord"))
        frontier = settled(found)
        if not n:
            break
        reached += min(n, room)
        seen = seen.union(frontier)
    return seen.select("url", "depth", "discovered_from")
