"""The catalogue of rules, and the decorator by which further rules join it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("critical", "important", "tip")
CATEGORIES = ("tech_meta", "structure", "content")
#: What a finding of a severity weighs (fixed values).
MULTIPLIER = {"critical": 3.0, "important": 1.5, "tip": 0.5}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    weight: float
    description: str


#: rule_id, category, severity, weight (fixed values), description.
_CATALOGUE = (
    ("meta.title.missing", "tech_meta", "critical", 3.0, "The page has no title"),
    ("meta.title.empty", "tech_meta", "critical", 3.0, "The title holds no text"),
    ("meta.title.too_short", "tech_meta", "important", 1.5, "The title is shorter than 30 characters"),
    ("meta.title.too_long", "tech_meta", "important", 1.5, "The title is longer than 65 characters"),
    ("meta.title.duplicate", "tech_meta", "important", 2.0, "Several pages share the title"),
    ("meta.description.missing", "tech_meta", "important", 2.0, "The page has no description"),
    ("meta.description.too_long", "tech_meta", "tip", 1.0, "The description is longer than 160 characters"),
    ("meta.description.too_short", "tech_meta", "tip", 1.0, "The description is shorter than 70 characters"),
    ("meta.description.duplicate", "tech_meta", "important", 2.0, "Several pages share the description"),
    ("heading.h1.missing", "tech_meta", "critical", 2.5, "The page has no top heading"),
    ("heading.h1.multiple", "tech_meta", "important", 1.5, "The page has more than one top heading"),
    ("content.image.alt_missing", "tech_meta", "important", 1.0, "Images lack an alternative text"),
    ("tech.response_time.slow", "tech_meta", "important", 1.5, "The answer took over 1500 ms"),
    ("tech.response_time.medium", "tech_meta", "tip", 0.5, "The answer took over 500 ms"),
    ("tech.language.missing", "tech_meta", "tip", 1.0, "The page declares no language"),
    ("tech.html.too_large", "tech_meta", "tip", 1.0, "The page is larger than a million bytes"),
    ("tech.charset.missing", "tech_meta", "tip", 0.5, "The page declares no character set"),
    ("tech.compression.missing", "tech_meta", "tip", 0.5, "The answer was not compressed"),
    ("heading.hierarchy.skipped", "tech_meta", "tip", 0.5, "A heading level is left out"),
    ("url.too_long", "tech_meta", "tip", 0.5, "The URL is longer than 115 characters"),
    ("url.too_deep", "tech_meta", "tip", 0.5, "The URL has more than 4 path segments"),
    ("url.dynamic_params", "tech_meta", "tip", 0.3, "The URL has query parameters"),
    ("url.session_id", "tech_meta", "important", 1.5, "The URL carries a session"),
    ("tech.fetch.failed", "tech_meta", "critical", 3.0, "The page could not be fetched"),
    ("tech.fetch.http_error", "tech_meta", "critical", 3.0, "The page answered with an error"),
    ("meta.robots.noindex", "tech_meta", "tip", 0.5, "The page asks not to be indexed"),
    ("tech.resource.broken", "tech_meta", "important", 1.0, "An embedded resource answers with an error"),
    ("tech.resource.unreachable", "tech_meta", "important", 1.0, "An embedded resource does not answer"),
    ("tech.resource.mixed_content", "tech_meta", "important", 1.5, "A secure page embeds an insecure resource"),
    ("structure.depth.deep", "structure", "tip", 0.5, "The page is 3 or 4 clicks away"),
    ("structure.depth.very_deep", "structure", "important", 1.0, "The page is 5 or more clicks away"),
    ("structure.inlinks.none", "structure", "important", 1.5, "No page links to this page"),
    ("structure.outlinks.none", "structure", "tip", 0.5, "The page links nowhere"),
    ("structure.outlinks.many", "structure", "tip", 0.5, "The page has more than 100 links"),
    ("structure.anchor.generic", "structure", "tip", 0.5, "A link text says nothing about its target"),
    ("structure.anchor.ambiguous", "structure", "important", 1.0, "One link text leads to different targets"),
    ("structure.canonical.cross_domain", "structure", "important", 1.5, "The canonical URL is on another site"),
    ("structure.canonical.mismatch", "structure", "tip", 0.5, "The canonical URL is another page"),
    ("structure.redirect.long_chain", "structure", "important", 1.0, "More than two redirects lead to the page"),
    ("structure.redirect.loop", "structure", "critical", 2.0, "Redirects run in a circle"),
    ("structure.external_link.broken", "structure", "important", 1.0, "An external link answers with an error"),
    ("structure.external_link.unreachable", "structure", "important", 1.0, "An external link does not answer"),
    ("structure.sitemap.in_sitemap_only", "structure", "important", 1.0, "A sitemap names a page that the crawl lacks"),
    ("structure.sitemap.in_crawl_only", "structure", "tip", 0.5, "The crawl has a page that no sitemap names"),
    ("content.thin", "content", "important", 1.5, "The main text has fewer than 100 words"),
    ("content.duplicate.page", "content", "critical", 2.5, "Several pages share the main text"),
    ("content.duplicate.near", "content", "important", 1.5, "The main text resembles another page's"),
    ("content.block.repeated", "content", "tip", 0.5, "A block of text stands on more than 3 pages"),
    ("content.keyword.title_not_in_body", "content", "important", 1.0, "The title's keyword is not in the text"),
    ("content.keyword.h1_not_in_body", "content", "important", 1.0, "The heading's keyword is not in the text"),
    ("content.keyword.cannibalization", "content", "important", 1.5, "Pages compete for a keyword"),
    ("content.spelling.errors", "content", "tip", 0.5, "The text has spelling errors"),
)
RULES: dict[str, Rule] = {}


def register(rule: Rule) -> Rule:
    if rule.rule_id in RULES:
        raise ValueError(f"rule {rule.rule_id} is registered already")
    if rule.severity not in SEVERITIES or rule.category not in CATEGORIES:
        raise ValueError(f"rule {rule.rule_id} has an unknown severity or category")
    RULES[rule.rule_id] = rule
    return rule


for _row in _CATALOGUE:
    register(Rule(*_row))

#: Rules of others: functions from the crawled pages to rows (page_url, payload).
EXTENSIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rule(rule_id: str, category: str, severity: str, weight: float = 1.0, description: str = ""):
    """Decorator that registers a function (pages) -> DataFrame(page_url, payload) as a rule."""

    def join(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        register(Rule(rule_id, category, severity, weight, description))
        EXTENSIONS[rule_id] = f
        return f

    return join


def rules_frame(spark: SparkSession) -> DataFrame:
    """(ord, rule_id, category, severity, weight, description): a few dozen rows, fit to broadcast."""
    rows = [(i, r.rule_id, r.category, r.severity, r.weight, r.description) for i, r in enumerate(RULES.values())]
    return spark.createDataFrame(rows,
        "ord int, rule_id string, category string, severity string, weight double, description string")


def payload(**columns: Column) -> Column:
    """JSON text of the columns; null ones are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def finding(rule_id: str, data: Column, url: Column | None = None) -> Column:
    """Struct of a finding of the rule."""
    r = RULES[rule_id]
    fields = [F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"),
        F.lit(r.severity).alias("severity"), data.cast("string").alias("payload")]
    return F.struct(*([url.alias("page_url")] if url is not None else []), *fields)


FINDING = ("page_url", "rule_id", "category", "severity", "payload")


def as_findings(rows: DataFrame, rule_id: str, data: Column, url: str = "page_url") -> DataFrame:
    """Findings of one rule from rows."""
    return rows.select(F.inline(F.array(finding(rule_id, data, F.col(url)))))
