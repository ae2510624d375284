"""robots.txt as RFC 9309 has it: groups by agent, longest match, wildcards; absent or failed means allowed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import host_of

_SITEMAP = r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"


def parse(text: str | None, agent: str) -> list[tuple[bool, str]]:
    """(allow, pattern) of the rules that hold for the agent: those of its own groups, or else of '*'."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    open_ = False
    for line in (text or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
        elif key:
            open_ = False
    own = agent.lower()
    named = [r for names, rules in groups if any(n != "*" and n in own for n in names) for r in rules]
    has_own = any(n != "*" and n in own for names, _ in groups for n in names)
    return named if has_own else [r for names, rules in groups if "*" in names for r in rules]


def delay(text: str | None, agent: str) -> float | None:
    """The seconds between two requests that the file asks of the agent: of its own groups, or else of '*'; null if it doesn't say."""
    named: list[str] = []
    found: dict[bool, float] = {}
    last = ""
    for line in (text or "").splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            named = [*named, value.lower()] if last == key else [value.lower()]
        elif key == "crawl-delay" and re.fullmatch(r"[0-9]+(\.[0-9]*)?", value):
            if any(n != "*" and n in agent.lower() for n in named):
                found.setdefault(True, float(value))
            if "*" in named:
                found.setdefault(False, float(value))
        last = key or last
    return found.get(True, found.get(False))


def delays(robots: DataFrame, agent: str) -> DataFrame:
    """(host, asked_delay_ms) of the hosts whose file asks for a delay."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: delay(t, agent)).astype(float)

    rows = robots.select("host", of("robots_txt").alias("seconds")).filter(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    return rows.groupBy("host").agg((F.max("seconds") * 1000).cast("long").alias("asked_delay_ms"))


def allowed(rules: list[tuple[bool, str]], url: str) -> bool:
    parts = urlsplit(url)
    path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    best = (-1, True)
    for allow, pattern in rules:
        end = pattern.endswith("$")
        expression = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else "")
        if re.match(expression, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def with_permission(pages: DataFrame, robots: DataFrame, agent: str, respect: bool = True) -> DataFrame:
    """pages with column allowed; robots (host, robots_txt) has a row for each host that has the file."""
    if not respect:
        return pages.withColumn("allowed", F.lit(True))

    def check(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str | None, list[tuple[bool, str]]] = {}
        for texts, links in parts:
            for text in texts.unique():
                if len(known) > 1000:
                    known.clear()
                known[text] = parse(text, agent)
            yield pd.Series([allowed(known.get(t) or parse(t, agent), u) for t, u in zip(texts, links)], dtype=bool)

    check.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    x = pages.withColumn("__host", host_of(F.col("url"))).join(robots.select(F.col("host").alias("__host"),
            "robots_txt"), "__host", "left")
    return x.withColumn("allowed", F.pandas_udf(check, "boolean")("robots_txt", "url")).select(*pages.columns,
        "allowed")


def sitemap_seeds(robots: DataFrame) -> DataFrame:
    """(host, sitemap_url): the sitemaps that robots.txt names, or else the usual place."""
    named = F.array_distinct(F.regexp_extract_all("robots_txt", F.lit(_SITEMAP), F.lit(1)))
    usual = F.array(F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap.xml")))
    return robots.select("host", F.explode(F.when(F.size(named) > 0, named).otherwise(usual)).alias("sitemap_url"))
