"""Audit of pages as they arrive: the rules that need one page only, on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.functions.html import extract
from auditlake.operators.tech import page_findings


def audit_stream(fetched: DataFrame) -> DataFrame:
    """Findings of a stream of fetched pages (url, html and fetch facts); stateless, so that no watermark is needed."""
    x = fetched.withColumn("is_html", F.col("fetch_error").isNull() & (F.col("status_code") < 400))
    return page_findings(extract(x))


def counts_by_window(findings: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, rule_id, count) of findings with a time column; findings later than ``late`` are left out."""
    return findings.withWatermark(time, late).groupBy(F.window(time, window),
        "rule_id").agg(F.count(F.lit(1)).alias("count"))


def start(findings: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run the audit, handing each batch of findings to sink with its number, all arrived pages first."""
    return findings.writeStream.foreachBatch(sink).option("checkpointLocation",
        checkpoint).trigger(availableNow=True).start()
