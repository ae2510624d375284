"""Technical and metadata rules.

Rules that need one page only are conditions in one array, so that a crawl is scanned once for all
of them. Duplicates group by text and keep a handful of URLs for each, never whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import urls
from auditlake.functions.text import blank, strip
from auditlake.operators.registry import FINDING, as_findings, finding, payload

TITLE_MIN, TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX = 30, 65, 70, 160
FAST_MS, MEDIUM_MS, HTML_MAX, URL_MAX, URL_DEPTH_MAX, EXAMPLES = 500, 1500, 1_000_000, 115, 4, 5
COMPRESSED = ("gzip", "br", "deflate", "zstd")


def _tokens(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda t: F.lower(strip(t)))


def _page_rules() -> list[tuple[str, Column, Column]]:
    """(rule_id, condition, payload) of the rules that look at one page."""
    c, none = F.col, F.lit("{}")
    answered, html = c("fetch_error").isNull() | (c("fetch_error") == ""), c("is_html")
    url, title, description = c("url"), c("title"), c("meta_description")
    page = answered & html
    levels = F.array_sort(F.transform(F.map_keys("headings"), lambda k: F.substring(k, 2, 1).cast("int")))
    gaps = F.filter(F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))),
            F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a,
            b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["b"] - g["a"] > 1)
    gap = F.try_element_at(gaps, F.lit(1))
    no_alt = F.filter("images", lambda i: ~i["has_alt"])
    robots = F.array_sort(F.array_distinct(_tokens(c("meta_robots"))))
    packed = F.arrays_overlap(_tokens(c("content_encoding")), F.array(*map(F.lit, COMPRESSED)))
    level = lambda x: F.concat(F.lit("h"), x.cast("string"))
    return [
        ("tech.fetch.failed", ~answered, payload(error=c("fetch_error"))),
        ("tech.fetch.http_error", answered & (c("status_code") >= 400), payload(status_code=c("status_code"))),
        ("url.too_long", answered & (F.length(url) > URL_MAX), payload(length=F.length(url), max=F.lit(URL_MAX))),
        ("url.too_deep", answered & (urls.depth(url) > URL_DEPTH_MAX),
            payload(depth=urls.depth(url), max=F.lit(URL_DEPTH_MAX))),
        ("url.session_id", answered & urls.has_session_id(url), none),
        ("url.dynamic_params", answered & urls.has_params(url) & ~urls.has_session_id(url), none),
        ("tech.response_time.slow", answered & (c("response_time_ms") > MEDIUM_MS),
            payload(ms=c("response_time_ms"), threshold=F.lit(MEDIUM_MS))),
        ("tech.response_time.medium", answered & (c("response_time_ms") > FAST_MS)
            & (c("response_time_ms") <= MEDIUM_MS), payload(ms=c("response_time_ms"), threshold=F.lit(FAST_MS))),
        ("meta.title.missing", page & title.isNull(), none),
        ("meta.title.empty", page & title.isNotNull() & blank(title), none),
        ("meta.title.too_short", page & ~blank(title) & (F.length(title) < TITLE_MIN),
            payload(length=F.length(title), min=F.lit(TITLE_MIN))),
        ("meta.title.too_long", page & ~blank(title) & (F.length(title) > TITLE_MAX),
            payload(length=F.length(title), max=F.lit(TITLE_MAX))),
        ("meta.description.missing", page & blank(description), none),
        ("meta.description.too_short", page & ~blank(description) & (F.length(description) < DESCRIPTION_MIN),
            payload(length=F.length(description), min=F.lit(DESCRIPTION_MIN))),
        ("meta.description.too_long", page & ~blank(description) & (F.length(description) > DESCRIPTION_MAX),
            payload(length=F.length(description), max=F.lit(DESCRIPTION_MAX))),
        ("heading.h1.missing", page & (c("h1_count") == 0), none),
        ("heading.h1.multiple", page & (c("h1_count") > 1), payload(count=c("h1_count"))),
        ("content.image.alt_missing", page & (F.size(no_alt) > 0),
            payload(count=F.size(no_alt), examples=F.slice(F.transform(no_alt, lambda i: i["src"]), 1, EXAMPLES))),
        ("tech.language.missing", page & blank(c("language")), none),
        ("tech.html.too_large", page & (c("html_size") > HTML_MAX), payload(bytes=c("html_size"), max=F.lit(HTML_MAX))),
        ("tech.charset.missing", page & blank(c("charset")), none),
        ("tech.compression.missing", page & ~F.coalesce(packed, F.lit(False)),
            payload(content_encoding=F.nullif("content_encoding", F.lit("")))),
        ("heading.hierarchy.skipped", page & gap.isNotNull(),
            payload(before=level(gap["a"]), after=level(gap["b"]),
                skipped=F.transform(F.sequence(gap["a"] + 1, gap["b"] - 1), level))),
        ("meta.robots.noindex", page & (c("meta_robots") != "")
            & F.arrays_overlap(robots, F.array(F.lit("noindex"), F.lit("none"))), payload(directives=robots)),
    ]


def page_findings(pages: DataFrame) -> DataFrame:
    """Findings of the rules that look at one page: one scan, one generator."""
    rules = [F.when(when, finding(rule_id, data, F.col("url"))) for rule_id, when, data in _page_rules()]
    return pages.select(F.inline(F.filter(F.array(*rules), lambda f: f.isNotNull())))


def values(pages: DataFrame, column: str) -> DataFrame:
    """(page_url, value) of HTML pages that have a text in the column."""
    rows = pages.filter("is_html").select(F.col("url").alias("page_url"),
        F.nullif(F.col(column), F.lit("")).alias("raw")).filter("raw is not null")
    return rows.select("page_url", strip(F.col("raw")).alias("value"))


def shared(rows: DataFrame) -> DataFrame:
    """rows (page_url, value) whose value other rows have too, with count and others, the first URLs of rows of another URL.

    A URL that several rows have stands among the others as often. The first URLs but one's own are
    among the first six of a value, so six are kept for each, with their copies.
    """
    copies = rows.groupBy("value", "page_url").agg(F.least(F.count(F.lit(1)), F.lit(EXAMPLES)).cast("int").alias("copies"))
    few = copies.withColumn("n", F.row_number().over(Window.partitionBy("value").orderBy("page_url"))).filter(
        F.col("n") <= EXAMPLES + 1)
    few = few.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("page_url", "copies"))).alias("few"))
    many = rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).filter("count > 1").join(few, "value")
    others = F.filter("few", lambda x: x["page_url"] != F.col("page_url"))
    others = F.flatten(F.transform(others, lambda x: F.array_repeat(x["page_url"], x["copies"])))
    return rows.join(many, "value").withColumn("others", F.slice(others, 1, EXAMPLES)).drop("few")


#: Columns whose values should be a page's own: rule, and payload of rows of ``shared``.
OWN_VALUES = {
    "title": ("meta.title.duplicate", lambda: payload(title=F.col("value"), count=F.col("count"), other_urls=F.col("others"))),
    "meta_description": ("meta.description.duplicate", lambda: payload(description=F.substring("value", 1, 200), count=F.col("count"),
        other_urls=F.col("others"))),
}


def duplicate_findings(pages: DataFrame) -> DataFrame:
    """Titles and descriptions that several pages share."""
    titles, descriptions = (as_findings(shared(values(pages, column)), rule_id, data()) for column, (rule_id, data) in OWN_VALUES.items())
    return titles.union(descriptions)


def resources(pages: DataFrame) -> DataFrame:
    """(page_url, url, resource_type, is_internal), one row for each resource of a page."""
    return pages.filter("is_html").select(F.col("url").alias("page_url"), F.inline("resources"))


def resource_findings(pages: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Insecure resources, and with statuses (url, status_code) those that fail. A URL that was not probed has no row there."""
    found = resources(pages)
    mixed = found.filter(F.col("page_url").startswith("https://") & F.col("url").startswith("http://"))
    out = as_findings(mixed, "tech.resource.mixed_content", payload(resource=F.col("url"), type=F.col("resource_type")))
    if statuses is None:
        return out
    probed = found.join(statuses.select("url", "status_code"), "url")
    broken = as_findings(probed.filter("status_code >= 400"), "tech.resource.broken",
        payload(resource=F.col("url"), type=F.col("resource_type"), status_code=F.col("status_code")))
    silent = as_findings(probed.filter("status_code is null"), "tech.resource.unreachable",
        payload(resource=F.col("url"), type=F.col("resource_type")))
    return out.union(broken).union(silent)


def tech_findings(pages: DataFrame, resource_statuses: DataFrame | None = None) -> DataFrame:
    return page_findings(pages).union(duplicate_findings(pages)).union(resource_findings(pages,
            resource_statuses)).select(*FINDING)
