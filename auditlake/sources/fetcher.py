"""Fetching pages: robots gate, GET with redirects, extraction; and the breadth-first crawl of a live site.

The client is the caller's: ``client("GET", url)`` returns an object with status_code, url (the
final one), history (URLs of the redirects), headers, content and encoding, or raises. Failures
become rows, never exceptions. URLs are dealt to tasks by hash, as many as they need, each is fetched once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.html import extract
from auditlake.functions.urls import is_same_site
from auditlake.sources.frontier import MAX_DEPTH, MAX_PAGES
from auditlake.sources.probes import URLS_A_TASK
from auditlake.sources.robots import with_permission
from auditlake.storage import in_tasks, materialize

BLOCKED = "blocked_by_robots"
HTML_TYPES = ("text/html", "application/xhtml+xml")
FETCHED = (
    "requested_url string, url string, status_code int, response_time_ms int, content_type string, body binary, encoding string, content_encoding string, redirect_chain array<string>, fetch_error string, "
    "depth int, discovered_from string"
)
_NAMES = [field.split()[0] for field in FETCHED.split(", ")]


def ok() -> Column:
    return F.coalesce(F.col("fetch_error").isNull() & F.col("status_code").between(200, 399), F.lit(False))


def is_html_type() -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))).isin(*HTML_TYPES),
        F.lit(False))


def _one(client: Callable, url: str, allowed: bool) -> tuple:
    if not allowed:
        return url, None, 0, None, b"", None, None, [], BLOCKED
    began = time.monotonic()
    took = lambda: int((time.monotonic() - began) * 1000)
    try:
        answer = client("GET", url)
        headers = {k.lower(): v for k, v in answer.headers.items()}
        return str(answer.url), answer.status_code, took(), headers.get(
            "content-type"), answer.content, answer.encoding, headers.get("content-encoding"), [str(u)
            for u in answer.history], None
    except Exception as e:  # noqa: BLE001 - what a client raises is the result
        return url, None, took(), None, b"", None, None, [], f"{type(e).__name__}: {e}"[:500]


def fetch(found: DataFrame, client: Callable, partitions: int | None = None) -> DataFrame:
    """``FETCHED`` of the rows (url, depth, discovered_from, allowed); what robots.txt forbids is not asked for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.url, *_one(client, r.url, bool(r.allowed)), r.depth, r.discovered_from)
                for r in part.itertuples()]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"status_code": "Int32", "response_time_ms": "int32",
                    "depth": "Int32"})

    columns = found.select("url", F.col("depth").cast("int").alias("depth"),
        F.col("discovered_from").cast("string").alias("discovered_from"), "allowed")
    dealt = columns.repartition(partitions, "url") if partitions else in_tasks(columns, "url", URLS_A_TASK)
    return dealt.mapInPandas(run, FETCHED)


def process(found: DataFrame, robots: DataFrame, client: Callable, agent: str, respect: bool = True,
        partitions: int | None = None) -> DataFrame:
    """The crawled pages of the rows (url, depth, discovered_from): gate, fetch, and the facts of those that are HTML.

    robots (host, robots_txt) has a row for each host that has the file. is_html tells that the
    page has facts: it was answered well, as HTML and with a body.
    """
    gated = with_permission(found.select("url", "depth", "discovered_from"), robots, agent, respect)
    return facts(fetch(gated, client, partitions))


def facts(pages: DataFrame) -> DataFrame:
    """Fetched pages (``FETCHED``) with blocked_by_robots, is_html and, where that is true, what their HTML tells."""
    pages = pages.withColumn("blocked_by_robots", F.col("fetch_error").eqNullSafe(F.lit(BLOCKED)))
    pages = pages.withColumn("is_html", ok() & is_html_type() & (F.octet_length("body") > 0))
    # read as UTF-8 unless the answer says otherwise or the bytes aren't; other encodings by their bytes
    said = F.lower(F.coalesce("encoding", F.lit("utf-8"))).isin("utf-8", "utf8", "ascii", "us-ascii")
    read = F.coalesce(F.when(said, F.try_validate_utf8(F.col("body").cast("string"))),
        F.decode(F.col("body"), "ISO-8859-1"))
    return extract(pages.withColumn("html", F.when(F.col("is_html"), read).otherwise("")).drop("body"))


def crawl_site(spark: SparkSession, base_url: str, robots: DataFrame, client: Callable, agent: str,
        max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, respect: bool = True, partitions: int | None = None) -> DataFrame:
    """The crawled pages of the site, level by level; each level is fetched once and written before it is read.

    Links are followed whether nofollow or not, from pages of the start's site to URLs that those
    pages' own sites hold; where the budget of pages ends inside a level, URLs go by their first
    page's order and their place in it.
    """
    seen = materialize(spark.createDataFrame([(base_url, 0, None, 0)],
            "url string, depth int, discovered_from string, ord long"), "seen")
    frontier, pages, reached = seen, None, 1
    for depth in range(max_depth + 1):
        level = materialize(process(frontier, robots, client, agent, respect,
                partitions).join(frontier.select(F.col("url").alias("requested_url"), "ord"), "requested_url"), "level")
        pages = level if pages is None else pages.unionByName(level)
        if depth == max_depth or reached >= max_pages:
            break
        expanded = level.filter(F.col("is_html") & is_same_site(F.col("url"), F.lit(base_url)))
        links = expanded.select("ord", F.col("url").alias("source"),
            F.posexplode("links").alias("at", "link")).filter("link.is_internal")
        first = links.groupBy(F.col("link.target_url").alias("url")).agg(F.min(F.struct("ord", "at",
                    "source")).alias("by"))
        new = first.join(seen.select("url"), "url", "left_anti").orderBy("by", "url").limit(max_pages - reached)
        new = new.select("url", F.lit(depth + 1).alias("depth"), F.col("by.source").alias("discovered_from"),
            (F.monotonically_increasing_id() + reached).alias("ord"))
        frontier = materialize(new, "frontier")
        n = frontier.count()
        if not n:
            break
        reached += n
        seen = seen.union(frontier)
    return pages.drop("ord")
