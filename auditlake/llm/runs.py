"""Streaming over rows sorted by a bucket key: whole buckets, in arrays, without a call for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import fresh, own_columns


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys in column key, by which rows are sorted; what may go on waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if waiting and waiting[0].column("key")[0].as_py() != key[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.r_[starts[1:], len(key)]


#: Keys with at least one in so many rows are heavy: there can't be more of them than that.
HEAVY = 1000
#: Keys that the sketch follows; any with one in HEAVY rows is sure to be among them.
TRACKED = 20_000
#: Rows of one bucket that are never too many for a task.
FEW = 512


def heavy_keys(rows: DataFrame, large: int) -> tuple[DataFrame, int]:
    """((key, most) of the keys with over the second value and one in ``HEAVY`` of all rows, ``HEAVY`` at most; rows that a task may get of a key).

    One pass with a sketch in each task; most is at least the key's number of rows. The sketch
    decides only how a key's rows are dealt, never what comes of them.
    """
    items, n = rows.agg(F.expr(f"approx_top_k(key, {HEAVY}, {TRACKED})"), F.count(F.lit(1))).first()
    large = min(large, max(FEW, 2 * n // HEAVY))
    found = [(r["item"], r["count"]) for r in items if r["count"] > large and r["count"] * HEAVY >= n]
    return rows.sparkSession.createDataFrame(found, "key long, most long"), large


def bucketed(rows: DataFrame, member: str, large: int, keep=None, chunk: str | None = None) -> DataFrame:
    """Rows (key, ...) without buckets of one row, large buckets split; ``dealt`` brings them to tasks.

    A bucket of over ``large`` rows, or of a small table over ``2 / HEAVY`` of them, is cut into chunks by a hash of ``member``, and each pair of
    chunks is a bucket of its own, so that any two members still meet in some bucket, and no task
    gets more than about ``large`` rows of one bucket. Heavy buckets are known beforehand and are
    split where their rows lie; only others are counted by a window, which sends a bucket to one
    task. rows is read twice and should be a written table or cheap. keep: what else a bucket
    needs, from the window over its rows. chunk: name of a column that tells the chunks apart.
    """
    w = Window.partitionBy("key")
    columns = rows.columns
    heavy, large = heavy_keys(rows, large)
    heavy = F.broadcast(heavy)
    light = rows.join(heavy, "key", "left_anti").withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__keep",
        F.lit(True) if keep is None else keep(w))
    light = light.filter((F.col("__n") > 1) & F.col("__keep")).drop("__keep")
    x = light.select(*columns, "__n").union(rows.join(heavy, "key").select(*columns, F.col("most").alias("__n")))
    chunks = F.ceil(F.col("__n") * 2 / large).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("chunk"), member), chunks).cast("int")
    # the unit of a chunk with itself has chunk -1: only there do members of one chunk count
    unit = lambda j: F.struct(F.xxhash64(F.col("key"), F.least("__c", j), F.greatest("__c", j)).alias("key"),
        F.when(F.col("__c") == j, -1).otherwise(F.col("__c")).alias("chunk"))
    whole = F.array(F.struct(F.col("key").alias("key"), F.lit(-1).alias("chunk")))
    units = F.when(F.col("__n") <= large, whole).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), unit))
    x = x.withColumn("__c", mine).withColumn("__u", F.explode(units))
    return x.select(F.col("__u.key").alias("key"), *[c for c in columns if c != "key"],
        *([F.col("__u.chunk").alias(chunk)] if chunk else []))


def looked_up(rows: DataFrame, table: DataFrame, key: str, table_key: str, size: str, values: dict[str, str],
        spread: list, merge: bool = False) -> DataFrame:
    """rows with columns of table (values: name there -> name here), null where the key isn't there.

    table has one row for each key and in ``size`` how many rows have it. The keys with one in
    ``HEAVY`` of those rows, so ``HEAVY`` at most, are broadcast; their rows need no other task and
    are dealt by ``spread``, columns that tell rows apart. merge: a merge join for the rest at every
    size, for tables that grow with the data. table is read three times and should be written.
    """
    names = fresh(rows, "__key", "__heavy", *(f"__heavy_{v}" for v in values), *(f"__light_{v}" for v in values),
        "__dealt")
    own, flag, dealt_by = names[0], names[1], names[-1]
    heavies, lights = names[2 : 2 + len(values)], names[2 + len(values) : -1]
    total = table.agg(F.sum(size)).first()[0] or 0
    heavy = (F.col(size) > 1) & (F.col(size) * HEAVY >= total)
    few = table.filter(heavy).select(F.col(table_key).alias(own), F.lit(True).alias(flag),
        *[F.col(v).alias(h) for v, h in zip(values, heavies)])
    x = rows.join(F.broadcast(few), F.col(key) == F.col(own), "left").drop(own)
    kind = rows.schema[key].dataType.simpleString()
    elsewhere = F.xxhash64(F.lit("elsewhere"), *spread)
    x = x.withColumn(dealt_by, F.when(F.col(flag), elsewhere if kind == "bigint"
            else F.concat(F.lit("-"), elsewhere.cast("string"))).otherwise(F.col(key)))
    rest = table.filter(~heavy).select(F.col(table_key).alias(own),
        *[F.col(v).alias(v_) for v, v_ in zip(values, lights)])
    x = x.join(rest.hint("merge") if merge else rest, F.col(dealt_by) == F.col(own), "left")
    found = [F.when(F.col(flag), F.col(h)).otherwise(F.col(v_)).alias(name) for h, v_,
        name in zip(heavies, lights, values.values())]
    return x.select(*own_columns(rows), *found)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")
