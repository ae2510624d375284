"""Lists laid out in their order, and pages of them that read what they show.

A list is written once, ranged and sorted by its order, with each row's place in it. Files and row
groups then hold ranges of places, whose bounds Parquet keeps, so a page is a range of places that
the scan finds by itself: its cost doesn't grow with the list or with how far the page is. A page
of rows that also meet a condition begins after the last row shown and takes ranges of growing
length until it is full, so that it reads no more than a few times the rows up to its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.storage import materialize

#: Rows of a column page, below which nothing is skipped.
PAGE_ROWS = 2000
#: Bits that number a row inside its partition in monotonically_increasing_id.
_INSIDE = (1 << 33) - 1


def laid_out(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with place: 1, 2, ... in that order; to be written as they come (``write``). The order should tell all rows apart."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialize(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at",
        F.monotonically_increasing_id()), "list")
    # one row for each partition
    sizes = runs.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(earlier, F.lit(0)).alias("__before"))
    place = (F.col("__before") + F.col("__at").bitwiseAND(F.lit(_INSIDE)) + 1).cast("long")
    return runs.join(F.broadcast(sizes), "__part").select(place.alias("place"), *rows.columns)


def running(rows: DataFrame, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """rows of ``laid_out`` with name: the sum of value over all places up to the row's, by blocks of places, never in one task."""
    x = rows.withColumn("__block", F.floor(F.col("place") / block))
    # one row for each block
    sums = x.groupBy("__block").agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__block", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy("place"))
    return x.join(sums, "__block").withColumn(name, F.col("__earlier") + inside).drop("__block", "__earlier")


def write(rows: DataFrame, path: str, *order: str | Column) -> None:
    """Lay rows out in that order at path. Pages of columns are short, so that the scan can skip most of a file."""
    laid_out(rows, *order).write.mode("error").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def page(rows: DataFrame, limit: int, after: int = 0, condition: Column | None = None, longest: int = 500) -> DataFrame:
    """The next ``limit`` rows of a list that ``write`` laid out, behind the place ``after``, of those that meet the condition."""
    limit = min(limit, longest)
    if condition is None:
        return rows.filter((F.col("place") > after) & (F.col("place") <= after + limit)).orderBy("place")
    end, span = rows.agg(F.max("place")).first()[0] or 0, 4 * limit
    while True:
        found = rows.filter((F.col("place") > after) & (F.col("place") <= after + span)).filter(condition)
        if after + span >= end or found.limit(limit).count() == limit:
            return found.orderBy("place").limit(limit)
        span *= 4


def at(rows: DataFrame, offset: int, limit: int, longest: int = 500) -> DataFrame:
    """The page that begins after ``offset`` rows of the whole list."""
    return page(rows, limit, offset, longest=longest)
