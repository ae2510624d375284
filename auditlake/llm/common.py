"""What the operators share: session settings, tables in the shared folder, small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.storage import discard, materialize, shared_folder

__all__ = ["BATCH_ROWS", "SPACE", "bounded_batches", "discard", "fresh", "materialize", "no_nulls", "own_columns",
    "shared_folder", "table"]

#: White space of the text contracts: U+0020 and U+0009 to U+000D, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch for operators that hold whole texts in Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of texts small, for the rest of the session: plans run later than they are made. Never raises a lower setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def no_nulls(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def own_columns(df: DataFrame) -> list:
    """The columns by name, also those with dots or back quotes in theirs."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
