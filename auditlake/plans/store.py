"""A crawl as tables: the flat pages and what hangs on them, written by crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import cut, strip


def pages_table(pages: DataFrame) -> DataFrame:
    """The flat columns of pages, cut to their sizes; empty texts become null."""
    c = F.col
    return pages.select(
        "page_id", F.substring("url", 1, 2048).alias("url"), "status_code", "response_time_ms", "content_hash",
        "html_size", cut(c("title"), 1024).alias("title"), cut(c("meta_description"), 2048).alias("meta_description"),
        cut(c("meta_robots"), 255).alias("meta_robots"), cut(c("canonical_url"), 2048).alias("canonical_url"),
        cut(c("h1"), 2048).alias("h1"), cut(c("language"), 16).alias("language"), "word_count", "depth",
        indexable().alias("is_indexable"),
        F.when(F.size("redirect_chain") > 0, F.col("redirect_chain")).alias("redirect_chain"),
        cut(c("fetch_error"), 512).alias("fetch_error"),
    )


def indexable():
    tokens = F.transform(F.split("meta_robots", ","), lambda t: F.lower(strip(t)))
    return ~F.coalesce(F.arrays_overlap(tokens, F.array(F.lit("noindex"), F.lit("none"))), F.lit(False))


def links_table(pages: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Links of pages, with the target's status where it was probed."""
    rows = pages.select(F.col("page_id").alias("source_page_id"), F.inline("links")).withColumn("target_url",
        F.substring("target_url", 1, 2048)).withColumn("rel", cut(F.col("rel"), 255))
    if statuses is None:
        return rows.withColumn("target_status_code", F.lit(None).cast("int"))
    return rows.join(statuses.select(F.col("url").alias("target_url"),
            F.col("status_code").alias("target_status_code")), "target_url", "left")


def images_table(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.inline("images")).select("page_id", F.substring("src", 1, 2048).alias("src"),
        F.substring("alt", 1, 2048).alias("alt"), "has_alt")


def resources_table(pages: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    rows = pages.select(F.col("page_id").alias("source_page_id"), F.col("url").alias("page_url"), F.inline("resources"))
    rows = rows.withColumn("is_mixed_content", F.col("page_url").startswith("https://")
        & F.col("url").startswith("http://")).drop("page_url")
    if statuses is None:
        return rows.withColumn("status_code", F.lit(None).cast("int"))
    return rows.join(statuses.select("url", "status_code"), "url", "left")


def blocks_table(pages: DataFrame) -> DataFrame:
    block = F.lower(strip(F.col("block")))
    return pages.select("page_id", F.explode("content_blocks").alias("block")).select("page_id",
        F.sha2(block.cast("binary"), 256).alias("block_hash"), F.substring("block", 1, 2000).alias("text_excerpt"),
        F.size(F.split(strip(F.regexp_replace("block", r"\s+", " ")), " ")).alias("word_count"))


def write(df: DataFrame, folder: str, name: str, crawl_id: int) -> None:
    """Write a table's rows of one crawl, in place of those it has of it."""
    df.withColumn("crawl_id", F.lit(crawl_id)).write.mode("overwrite").option("partitionOverwriteMode",
        "dynamic").partitionBy("crawl_id").parquet(f"{folder}/{name}")


def replace_sitemaps(sitemaps: DataFrame, folder: str, project_id: int) -> None:
    """Write (url, is_index, locs, error) as a project's sitemaps in place of its former ones; nothing happens if there are none."""
    if not sitemaps.isEmpty():
        count = F.when(F.col("is_index"), 0).otherwise(F.size("locs"))
        rows = sitemaps.select("url", count.alias("urls_count"),
            F.when(~F.col("is_index"), F.col("locs")).alias("urls"), F.substring("error", 1, 512).alias("fetch_error"),
            F.lit(project_id).alias("project_id"))
        rows.write.mode("overwrite").option("partitionOverwriteMode",
            "dynamic").partitionBy("project_id").parquet(f"{folder}/sitemaps")


def read(spark, folder: str, name: str, crawl_id: int) -> DataFrame:
    """A crawl's rows of a table; the filter prunes partitions."""
    return spark.read.parquet(f"{folder}/{name}").filter(F.col("crawl_id") == crawl_id)
