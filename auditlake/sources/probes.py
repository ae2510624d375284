"""Fetching and probing URLs, each distinct one once, through a client that the caller provides.

The engine has no network client of its own; ``client(method, url)`` returns an object with
status_code and headers, or raises. Failures become rows, never exceptions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.storage import in_tasks

#: URLs that a task asks for, one after another.
URLS_A_TASK = 500


def probe(found: DataFrame, client: Callable, partitions: int | None = None) -> DataFrame:
    """(url, status_code, error, response_time_ms) of the distinct URLs in column url: HEAD, then GET where HEAD is refused.

    partitions: how many tasks ask, so many as the URLs need if not said; a task that is run again asks for its own URLs only.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url in part["url"]:
                began = time.monotonic()
                status = error = None
                try:
                    status = client("HEAD", url).status_code
                    if status in (405, 501):
                        status = client("GET", url).status_code
                except Exception as e:  # noqa: BLE001 - what a client raises is the result
                    status, error = None, f"{type(e).__name__}: {e}"[:500]
                rows.append((url, status, error, int((time.monotonic() - began) * 1000)))
            yield pd.DataFrame(rows, columns=["url", "status_code", "error",
                    "response_time_ms"]).astype({"status_code": "Int32", "response_time_ms": "int32"})

    asked = found.select("url").filter(F.col("url").isNotNull()).distinct()
    asked = asked.repartition(partitions, "url") if partitions else in_tasks(asked, "url", URLS_A_TASK)
    return asked.mapInPandas(run, "url string, status_code int, error string, response_time_ms int")


def external_targets(edges: DataFrame) -> DataFrame:
    return edges.filter("not is_internal").select(F.col("target_url").alias("url")).distinct()
