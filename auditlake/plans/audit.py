"""The whole audit of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.content import content_findings
from auditlake.operators.registry import EXTENSIONS, FINDING, as_findings
from auditlake.operators.scoring import category_scores
from auditlake.operators.structure import structure_findings
from auditlake.operators.tech import tech_findings


def audit(pages: DataFrame, base_url: str, external_statuses: DataFrame | None = None, resource_statuses: DataFrame
        | None = None, sitemap_urls: DataFrame | None = None, spelling: DataFrame | None = None) -> DataFrame:
    """All findings of a crawl, those of registered extensions included.

    pages is read by each branch and should be a written table, so that a branch reads its own columns.
    """
    out = tech_findings(pages, resource_statuses).union(structure_findings(pages, base_url, external_statuses,
            sitemap_urls)).union(content_findings(pages, spelling))
    for rule_id, f in EXTENSIONS.items():
        out = out.union(as_findings(f(pages), rule_id, F.col("payload")).select(*FINDING))
    return out


def scores(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Category scores; HTML pages are what findings are weighed against."""
    return category_scores(findings, pages.filter("is_html"))
