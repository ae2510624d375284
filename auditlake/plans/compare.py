"""Comparison of two crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.registry import SEVERITIES


def _first(issues: DataFrame) -> DataFrame:
    """One issue, the first, for each rule and URL."""
    order = Window.partitionBy("rule_id", "page_url").orderBy("id")
    return issues.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select("rule_id", "page_url",
        "category", "severity", "payload")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket new / resolved / persistent, rule_id, page_url, category, severity, payload); missing URLs equal each other.

    Payloads are those of the later crawl, of resolved issues those of the earlier.
    """
    a, b = _first(before).alias("a"), _first(after).alias("b")
    both = a.join(b, (F.col("a.rule_id") == F.col("b.rule_id")) & F.col("a.page_url").eqNullSafe(F.col("b.page_url")),
        "full_outer")
    bucket = F.when(F.col("a.rule_id").isNull(), "new").when(F.col("b.rule_id").isNull(),
        "resolved").otherwise("persistent")
    side = lambda c: F.when(F.col("b.rule_id").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = both.select(bucket.alias("bucket"), *[side(c).alias(c)
            for c in ("rule_id", "page_url", "category", "severity", "payload")])
    return rows.orderBy("bucket", rank, "rule_id", F.coalesce("page_url", F.lit("")))


def score_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, before, after, delta) of two score tables (category, score)."""
    a, b = before.select("category", F.col("score").alias("before")), after.select("category",
        F.col("score").alias("after"))
    return a.join(b, "category", "full_outer").select("category", "before", "after",
        F.round(F.col("after") - F.col("before"), 2).alias("delta"))


def ordered(first: int, second: int) -> tuple[int, int]:
    """The earlier and the later crawl's id; one crawl can't be compared with itself."""
    if first == second:
        raise ValueError("two different crawls are needed")
    return min(first, second), max(first, second)
