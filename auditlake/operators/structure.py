"""Rules on the link graph, redirects, canonical URLs and sitemaps.

The graph is a table of edges. Pages of one URL each have their findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.text import strip
from auditlake.operators.registry import FINDING, as_findings, payload

DEEP, VERY_DEEP, MANY_LINKS, LONG_CHAIN, SHOWN = 3, 5, 100, 2, 5
#: Pages other than the start page.
NO_START = "not (depth <=> 0)"
#: Link texts that say nothing (fixed values).
GENERIC = (
    "hier", "klick", "klicken", "klick hier", "hier klicken", "mehr", "mehr lesen", "weiterlesen", "weiter",
    "mehr erfahren", "click", "click here", "here", "more", "read more", "learn more", "link", "this", "this link",
)


def edges(pages: DataFrame) -> DataFrame:
    """(source_url, target_url, anchor_text, rel, is_internal, is_followed), one row for each link."""
    return pages.filter("is_html").select(F.col("url").alias("source_url"), F.inline("links"))


def _html_urls(pages: DataFrame) -> DataFrame:
    return pages.filter("is_html").select(F.col("url").alias("page_url"))


def depth_findings(pages: DataFrame) -> DataFrame:
    rows = pages.filter("is_html").select(F.col("url").alias("page_url"), "depth")
    deep = as_findings(rows.filter((F.col("depth") >= DEEP) & (F.col("depth") < VERY_DEEP)), "structure.depth.deep",
        payload(depth=F.col("depth"), threshold=F.lit(DEEP)))
    return deep.union(as_findings(rows.filter(F.col("depth") >= VERY_DEEP), "structure.depth.very_deep",
            payload(depth=F.col("depth"), threshold=F.lit(VERY_DEEP))))


def orphan_findings(pages: DataFrame) -> DataFrame:
    """Pages, but for the start page, that no internal link leads to; a link to itself counts."""
    linked = edges(pages).filter("is_internal").select(F.col("target_url").alias("page_url"))
    return as_findings(unlinked(_html_urls(pages.filter(NO_START)), linked), "structure.inlinks.none", F.lit("{}"))


def unlinked(urls: DataFrame, reached: DataFrame) -> DataFrame:
    """The rows of urls (page_url) whose URL is not among those that something leads to."""
    return urls.join(reached.distinct(), "page_url", "left_anti")


def outlink_findings(pages: DataFrame) -> DataFrame:
    """The links of a URL's pages count together; without any each page has a finding."""
    counts = pages.filter("is_html").groupBy(F.col("url").alias("page_url")).agg(F.sum(F.size("links")).alias("count"),
        F.count(F.lit(1)).alias("pages"))
    each = counts.filter("count = 0").select("page_url", F.explode(F.sequence(F.lit(1), F.col("pages"))))
    none = as_findings(each, "structure.outlinks.none", F.lit("{}"))
    return none.union(as_findings(counts.filter(F.col("count") > MANY_LINKS), "structure.outlinks.many",
            payload(count=F.col("count"), threshold=F.lit(MANY_LINKS))))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_url, target_url, shown, anchor): links with a text, as it is shown and in lower case."""
    return edges(pages).select(F.col("source_url").alias("page_url"), "target_url",
        strip(F.col("anchor_text")).alias("shown")).withColumn("anchor", F.lower("shown")).filter("anchor <> ''")


def anchor_findings(pages: DataFrame) -> DataFrame:
    rows = anchors(pages)
    generic = as_findings(rows.filter(F.col("anchor").isin(*GENERIC)), "structure.anchor.generic",
        payload(anchor=F.col("shown"), target=F.col("target_url")))
    return generic.union(as_findings(ambiguous(rows), AMBIGUOUS, payload(anchor=F.col("anchor"), targets=F.col("targets"))))


AMBIGUOUS = "structure.anchor.ambiguous"


def ambiguous(rows: DataFrame) -> DataFrame:
    """(anchor, page_url, targets) of ``anchors`` rows whose text leads to several targets."""
    # a few targets suffice to show; two tell that a text is ambiguous
    targets = rows.select("anchor", "target_url").distinct()
    few = targets.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy("target_url"))).filter(
        F.col("n") <= SHOWN)
    few = few.groupBy("anchor").agg(F.array_sort(F.collect_list("target_url")).alias("targets")).filter(
        F.size("targets") > 1)
    return rows.select("anchor", "page_url").distinct().join(few, "anchor")


def canonical_findings(pages: DataFrame, base_url: str) -> DataFrame:
    c = F.col("canonical_url")
    rows = pages.filter(F.col("is_html") & (c != "") & (c != F.col("url"))).select(F.col("url").alias("page_url"),
        "canonical_url")
    near = urls.is_same_site(c, F.lit(base_url))
    cross = as_findings(rows.filter(~near), "structure.canonical.cross_domain",
        payload(canonical=c, canonical_host=urls.host_of(c)))
    return cross.union(as_findings(rows.filter(near), "structure.canonical.mismatch", payload(canonical=c)))


def redirect_findings(pages: DataFrame) -> DataFrame:
    """Of all pages that were fetched, whether HTML or not."""
    rows = pages.filter(F.size("redirect_chain") > 0).select(F.col("url").alias("page_url"), "redirect_chain",
        F.array_append("redirect_chain", F.col("url")).alias("whole"))
    loop = F.size(F.array_distinct("whole")) < F.size("whole")
    loops = as_findings(rows.filter(loop), "structure.redirect.loop", payload(chain=F.col("whole")))
    long_ = rows.filter(~loop & (F.size("redirect_chain") > LONG_CHAIN))
    return loops.union(as_findings(long_, "structure.redirect.long_chain",
            payload(hops=F.size("redirect_chain"), chain=F.col("redirect_chain"))))


def external_findings(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """One finding for each link whose target was probed, in statuses (url, status_code), and fails."""
    rows = edges(pages).select(F.col("source_url").alias("page_url"),
        F.col("target_url").alias("url")).join(statuses.select("url", "status_code"), "url")
    silent = as_findings(rows.filter("status_code is null"), "structure.external_link.unreachable",
        payload(target=F.col("url")))
    return silent.union(as_findings(rows.filter("status_code >= 400"), "structure.external_link.broken",
            payload(target=F.col("url"), status_code=F.col("status_code"))))


def sitemap_findings(pages: DataFrame, sitemap_urls: DataFrame, base_url: str) -> DataFrame:
    """Differences between the crawl and the URLs of the site's own in sitemap_urls (url)."""
    named = sitemap_urls.select(F.col("url").alias("page_url")).filter(urls.is_same_site(F.col("page_url"),
            F.lit(base_url))).distinct()
    crawled = _html_urls(pages)
    missed = as_findings(named.join(crawled, "page_url", "left_anti"), "structure.sitemap.in_sitemap_only", F.lit("{}"))
    return missed.union(as_findings(crawled.join(named, "page_url", "left_anti"), "structure.sitemap.in_crawl_only",
            F.lit("{}")))


def structure_findings(pages: DataFrame, base_url: str, external_statuses: DataFrame | None = None,
        sitemap_urls: DataFrame | None = None) -> DataFrame:
    parts = [depth_findings(pages), orphan_findings(pages), outlink_findings(pages), anchor_findings(pages),
        canonical_findings(pages, base_url), redirect_findings(pages)]
    if external_statuses is not None:
        parts.append(external_findings(pages, external_statuses))
    if sitemap_urls is not None:
        parts.append(sitemap_findings(pages, sitemap_urls, base_url))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(*FINDING)
