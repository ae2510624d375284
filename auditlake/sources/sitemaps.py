"""Sitemaps: reading (plain or gzip), parsing, and the bounded walk through indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import normalize
from auditlake.sources.frontier import settled

MAX_DEPTH, MAX_SITEMAPS = 3, 50
#: Bytes that a gzipped sitemap may hold: the protocol's 50 MB.
MOST_BYTES = 52_428_800
_LOC = r"(?i)<loc>\s*([^<]+?)\s*</loc>"


def inflated(data: bytes, most: int = MOST_BYTES) -> bytes:
    """The gzip members in data; an error as soon as they hold more than ``most`` bytes, of which no more are ever made."""
    out = bytearray()
    while data:
        member = zlib.decompressobj(wbits=31)
        out += member.decompress(data, most + 1 - len(out))
        if len(out) > most:
            raise OSError(f"more than {most} bytes inflated")
        if not member.eof:
            raise EOFError("the file ends before its end mark")
        data = member.unused_data.lstrip(b"\0")
    return bytes(out)


def decoded(bodies: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(url, xml, error) of (url, body binary): gunzipped where the name or the first bytes say so, an error where it is more than ``most`` bytes."""

    def gunzip(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for links, data in parts:
            xml, error = [], []
            for u, b in zip(links, data):
                try:
                    raw = inflated(b, most) if b is not None and (u.lower().endswith(".gz")
                        or b[:2] == b"\x1f\x8b") else b
                    xml.append(raw.decode("utf-8", "replace") if raw is not None else None)
                    error.append("no response" if raw is None else None)
                except (OSError, EOFError, zlib.error) as e:
                    xml.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"xml": xml, "error": error}, dtype=object)

    gunzip.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return bodies.select("url", F.pandas_udf(gunzip, "xml string, error string")("url",
            "body").alias("x")).select("url", "x.*")


class _Locs(HTMLParser):
    """Texts of the loc elements, an open one's until an outer end tag."""

    def __init__(self):
        super().__init__()
        self.stack: list[str] = []
        self.open: dict[str, list[int]] = {}  # places on the stack by name
        self.inside: list[tuple[int, int]] = []  # (place, number) of the open locs
        self.locs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "loc":
            self.inside.append((len(self.stack), len(self.locs)))
            self.locs.append("")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)

    handle_startendtag = handle_starttag  # in HTML the slash closes nothing

    def handle_endtag(self, tag):
        if self.open.get(tag):
            place = self.open[tag][-1]
            while len(self.stack) > place:
                self.open[self.stack.pop()].pop()
            while self.inside and self.inside[-1][0] >= place:
                self.inside.pop()

    def handle_data(self, data):
        for _, loc in self.inside:
            self.locs[loc] += data.strip()


def _html_locs(text: str) -> list[str]:
    parser = _Locs()
    parser.feed(text)
    parser.close()
    return [x for x in parser.locs if x]


def parsed(sitemaps: DataFrame) -> DataFrame:
    """(url, is_index, locs, ...) of (url, xml, ...): the places named, resolved against the sitemap's URL and normalised.

    Where the pattern finds none but there is "<loc", as with attributes or spaces in the tag, the text is parsed as HTML.
    """

    def resolve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, lists, odd in parts:
            lists = [_html_locs(t) if t is not None else xs if xs is not None else [] for xs, t in zip(lists, odd)]
            yield pd.Series([[u for u in (normalize(x, b) for x in xs) if u] for b, xs in zip(bases, lists)])

    resolve.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    locs = F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1))
    odd = F.when((F.size(locs) == 0) & F.lower("xml").contains("<loc"), F.col("xml"))
    others = [c for c in sitemaps.columns if c not in ("url", "xml")]
    return sitemaps.select(*others, "url", F.coalesce(F.lower("xml").contains("<sitemapindex"), F.lit(False)).alias("is_index"),
        F.pandas_udf(resolve, "array<string>")("url", locs, odd).alias("locs"))


def walk(seeds: DataFrame, sitemaps: DataFrame, max_depth: int = MAX_DEPTH,
        max_sitemaps: int = MAX_SITEMAPS) -> DataFrame:
    """(url, depth, is_index, locs) of the sitemaps that seeds (url, and position if given) lead to through indexes, each once.

    First come, first served: a level's sitemaps in order of the one that names them and their
    place in it. A sitemap that is named but not in sitemaps counts towards the bound, as one that
    can't be fetched; it has no places.
    """
    known = settled(parsed(sitemaps))
    order = F.col("position").cast("long") if "position" in seeds.columns else F.lit(0).cast("long")
    first = seeds.groupBy("url").agg(F.min(order).alias("by"))
    seen = frontier = _level(first, 0, 0, max_sitemaps)
    for depth in range(1, max_depth + 1):
        room = max_sitemaps - seen.count()
        if room <= 0:
            break
        named = known.filter("is_index").join(frontier.select("url", "ord"), "url").select("ord",
            F.posexplode("locs").alias("at", "url"))
        first = named.groupBy("url").agg(F.min(F.struct("ord", "at")).alias("by")).join(seen, "url", "left_anti")
        frontier = _level(first, depth, max_sitemaps * depth, room)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.select("url", "depth").join(known, "url", "left").select("url", "depth",
        F.coalesce("is_index", F.lit(False)).alias("is_index"),
        F.coalesce("locs", F.array().cast("array<string>")).alias("locs"))


def _level(first: DataFrame, depth: int, start: int, room: int) -> DataFrame:
    """(url, depth, ord) of the first ``room`` rows in order of by."""
    return settled(first.orderBy("by", "url").limit(room).select("url", F.lit(depth).alias("depth"),
            (F.monotonically_increasing_id() + start).alias("ord")))


def sitemap_urls(walked: DataFrame) -> DataFrame:
    """(url): all pages that the sitemaps name."""
    return walked.filter("not is_index").select(F.explode("locs").alias("url")).distinct()
