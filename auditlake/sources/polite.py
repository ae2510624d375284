"""A crawl of many hosts that spares each of them, and goes on where it stopped.

The crawl goes level by level in rounds. A round takes of each host the next URLs of the level, as
many as ``per_host`` and the host's delay allow, and asks them one after another; so a host that
holds most URLs takes more rounds, not a larger task. Tasks serve their hosts in turn and wait for
each host's delay, counted from its last request, also that of an earlier round. A level whose URLs
all have an answer is expanded to the next one.

All state is in a store of commits: ``found-<level>`` (url, host, depth, discovered_from, ord) are
a level's URLs, ``pages-<level>-<round>`` the answers from that round on, with the round of each.
Each is one commit, so a driver that is lost costs the round that it was in; ``crawl`` with the
same store goes on behind it. An archive keeps no host waiting, so all rounds of a level that are
still to come are one commit there; the work of a crawl doesn't grow with its rounds.

Answers come from ``live`` (a client, asked at the pace of each host) or ``archived`` (a table of
stored answers, joined by URL).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.urls import host_of
from auditlake.snapshots import Store
from auditlake.sources import fetcher, robots as robots_txt

PER_HOST = 100
#: Milliseconds that a round may take at a host's delay; at least one URL is asked in any case.
ROUND_MS = 60_000
Fetch = Callable[[DataFrame], DataFrame]


def live(client: Callable, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """Answers of a client. A task gets whole hosts, asks their first URLs, then their second ones, and waits where a host needs it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for part in parts:
            rows = []
            for r in part.itertuples():
                if r.allowed:
                    due = last.get(r.host, r.last_ms / 1000) + r.delay_ms / 1000
                    if (wait := due - clock()) > 0:
                        sleep(wait)
                    last[r.host] = clock()
                at = int(1000 * last.get(r.host, clock()))
                rows.append((r.url, *fetcher._one(client, r.url, bool(r.allowed)), r.depth, r.discovered_from, at))
            yield pd.DataFrame(rows, columns=[*fetcher._NAMES, "asked_ms"]).astype({"status_code": "Int32",
                "response_time_ms": "int32", "depth": "Int32"})

    def fetch(wave: DataFrame) -> DataFrame:
        return wave.repartition("host").sortWithinPartitions("n", "host").mapInPandas(run, fetcher.FETCHED + ", asked_ms long")

    return fetch


def archived(answers: DataFrame) -> Fetch:
    """Answers of a table (url, status_code, html), a row for each URL: one that isn't there is not found. asked_ms is when its host would have been asked."""
    stored = answers.select(F.col("url").alias("__url"), F.col("status_code").alias("__status"), F.col("html").alias("__html"))

    def fetch(wave: DataFrame) -> DataFrame:
        x = wave.join(stored, (F.col("url") == F.col("__url")) & F.col("allowed"), "left")
        there, asked = F.col("__url").isNotNull(), F.col("allowed")
        values = {
            "requested_url": F.col("url"), "url": F.col("url"),
            "status_code": F.when(asked, F.when(there, F.col("__status")).otherwise(F.lit(404))).cast("int"),
            "response_time_ms": F.lit(0), "content_type": F.when(there, "text/html"),
            "body": F.coalesce(F.col("__html").cast("binary"), F.lit(b"")), "encoding": F.lit(None).cast("string"),
            "content_encoding": F.lit(None).cast("string"), "redirect_chain": F.array().cast("array<string>"),
            "fetch_error": F.when(~asked, fetcher.BLOCKED), "depth": F.col("depth"), "discovered_from": F.col("discovered_from"),
            "asked_ms": F.col("last_ms") + F.col("n") * F.col("delay_ms"), "round": F.col("round"),
        }
        return x.select(*[v.alias(k) for k, v in values.items()])

    fetch.waits = False
    return fetch


def crawl(store: Store, crawl_id: int, seeds: DataFrame, fetch: Fetch, robots: DataFrame, agent: str, max_pages: int = 1 << 40,
        max_depth: int = 5, per_host: int = PER_HOST, delay_ms: int = 1000, respect: bool = True, rounds: int | None = None) -> bool:
    """Crawl from seeds (url) on, or go on with a crawl that the store knows; whether it has ended.

    robots (host, robots_txt) may ask for longer delays. rounds: stop after so many, to go on later.
    ``pages`` reads what there is.
    """
    if not store.versions(crawl_id):
        first = _at_most(seeds.select("url").filter("url is not null").distinct().orderBy("url"), max_pages)
        first = first.select("url", host_of(F.col("url")).alias("host"), F.lit(0).alias("depth"),
            F.lit(None).cast("string").alias("discovered_from"), F.monotonically_increasing_id().alias("ord"))
        store.commit(crawl_id, {"found-0": first})
    done = 0
    while rounds is None or done < rounds:
        names = store.commit_of(crawl_id)["tables"]
        level = max(int(n.split("-")[1]) for n in names if n.startswith("found-"))
        asked = sorted(n for n in names if n.startswith(f"pages-{level}-"))
        if names[f"found-{level}"]["rows"] > sum(names[n]["rows"] for n in asked):
            first = _rounds(store, crawl_id, asked[-1]) if asked else 0
            at_once = 1 if getattr(fetch, "waits", True) else None if rounds is None else rounds - done
            wave = _wave(store, crawl_id, level, asked, robots, agent, per_host, delay_ms, respect, first, at_once)
            answers = fetcher.facts(fetch(wave))
            name = f"pages-{level}-{first:06d}"
            store.commit(crawl_id, {name: answers if "round" in answers.columns else answers.withColumn("round", F.lit(first))})
            if rounds is not None:
                done += 1 if at_once == 1 else _rounds(store, crawl_id, name) - first
            continue
        reached = sum(names[n]["rows"] for n in names if n.startswith("found-"))
        if level == max_depth or reached >= max_pages or not names[f"found-{level}"]["rows"]:
            return True
        store.commit(crawl_id, {f"found-{level + 1}": _next_level(store, crawl_id, level, asked, max_pages - reached)})
    return False


def _rounds(store: Store, crawl_id: int, name: str) -> int:
    """The rounds of a level up to the last one in that table."""
    return store.read(crawl_id, name).agg(F.max("round")).first()[0] + 1


def _at_most(rows: DataFrame, n: int) -> DataFrame:
    return rows.limit(n) if n < 1 << 31 else rows


def _union(store: Store, crawl_id: int, names: list[str], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (store.read(crawl_id, n).select(*columns) for n in names))


def _wave(store: Store, crawl_id: int, level: int, asked: list[str], robots: DataFrame, agent: str, per_host: int, delay_ms: int,
        respect: bool, first: int = 0, rounds: int | None = 1) -> DataFrame:
    """The next URLs of each host: (url, host, depth, discovered_from, ord, n, delay_ms, round, last_ms, allowed), n from 1 in each host.

    first: the number of the next round; rounds: how many of them, all that are left if not said.
    """
    waiting = store.read(crawl_id, f"found-{level}")
    if asked:
        waiting = waiting.join(_union(store, crawl_id, asked, "requested_url"), F.col("url") == F.col("requested_url"), "left_anti")
    turn = F.row_number().over(Window.partitionBy("host").orderBy("ord"))
    wave = waiting.withColumn("n", turn)
    if rounds is not None:  # a host's rows are cut where they lie, before they meet
        wave = wave.filter(F.col("n") <= min(per_host * rounds, (1 << 31) - 1))
    asks = robots_txt.delays(robots, agent) if respect else robots.select("host", F.lit(0).alias("asked_delay_ms")).limit(0)
    wave = wave.join(asks, "host", "left").withColumn("delay_ms",
        F.greatest(F.lit(delay_ms), F.coalesce("asked_delay_ms", F.lit(0))).cast("long")).drop("asked_delay_ms")
    # what a host's delay allows in a round, one URL at least
    allowed = F.when(F.col("delay_ms") > 0, F.greatest(F.lit(1), F.least(F.lit(per_host), F.floor(F.lit(ROUND_MS) / F.col("delay_ms"))))).otherwise(per_host)
    wave = wave.withColumn("round", (F.floor((F.col("n") - 1) / allowed) + first).cast("int"))
    if rounds is not None:
        wave = wave.filter(F.col("round") < first + rounds)
    before = [n for n in store.commit_of(crawl_id)["tables"] if n.startswith("pages-")]
    if before:
        last = _union(store, crawl_id, before, "requested_url", "asked_ms").groupBy(host_of(F.col("requested_url")).alias("host")).agg(
            F.max("asked_ms").alias("last_ms"))
        wave = wave.join(last, "host", "left")
    else:
        wave = wave.withColumn("last_ms", F.lit(None).cast("long"))
    return robots_txt.with_permission(wave.withColumn("last_ms", F.coalesce("last_ms", F.lit(0))), robots, agent, respect)


def _next_level(store: Store, crawl_id: int, level: int, asked: list[str], room: int) -> DataFrame:
    """URLs that the level's pages link to on their own sites and that are new, in order of their first page and place there."""
    order = store.read(crawl_id, f"found-{level}").select(F.col("url").alias("requested_url"), "ord")
    pages = _union(store, crawl_id, asked, "requested_url", "url", "links", "is_html").filter("is_html").join(order, "requested_url")
    links = pages.select("ord", F.col("url").alias("source"), F.posexplode("links").alias("at", "link")).filter("link.is_internal")
    first = links.groupBy(F.col("link.target_url").alias("url")).agg(F.min(F.struct("ord", "at", "source")).alias("by"))
    known = [n for n in store.commit_of(crawl_id)["tables"] if n.startswith("found-")]
    new = _at_most(first.join(_union(store, crawl_id, known, "url"), "url", "left_anti").orderBy("by", "url"), room)
    return new.select("url", host_of(F.col("url")).alias("host"), F.lit(level + 1).alias("depth"),
        F.col("by.source").alias("discovered_from"), F.monotonically_increasing_id().alias("ord"))


def pages(store: Store, crawl_id: int) -> DataFrame:
    """The pages that a crawl has asked for so far, with the level and round of each."""
    names = [n for n in store.commit_of(crawl_id)["tables"] if n.startswith("pages-")]
    return _union(store, crawl_id, names, *store.read(crawl_id, names[0]).columns)
