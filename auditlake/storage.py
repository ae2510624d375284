"""Tables that a job writes to the shared folder and reads again.

A written table cuts the lineage, survives lost executors, lets later plans prune columns and push
filters, and gives the planner its true size. The folder is the one that the cluster names in
spark.checkpoint.dir; only a local session may do without, all of whose tasks see one disk.
Tables of an application lie in one folder there, which goes when its JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = getattr(context, "_auditlake_shared", None)
    if found is None:
        found = context._auditlake_shared = "file://" + tempfile.mkdtemp(prefix="auditlake-")
    return found


def application_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    context = spark.sparkContext
    root = f"{shared_folder(spark)}/auditlake/{context.applicationId}"
    known = context.__dict__.setdefault("_auditlake_roots", set())
    if root not in known:
        known.add(root)
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no later plan reads."""
    context = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/auditlake/" in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that key, written when the session first asks for it, read from then on.

    key: what the table is, and the folder that it is made from; other files there, or changed ones,
    make it anew.
    """
    known = spark.sparkContext.__dict__.setdefault("_auditlake_tables", {})
    at = (*key, _stamp(spark, key[1]))
    if at not in known:
        known[at] = materialize(make(), str(key[0]))
    return known[at]


def made(spark: SparkSession, key: tuple) -> bool:
    """Whether the session has the table of that key."""
    return (*key, _stamp(spark, key[1])) in spark.sparkContext.__dict__.get("_auditlake_tables", {})


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files in a folder's tables, one level of folders deep."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    found = []
    for entry in system.listStatus(path) if system.exists(path) else []:
        inside = system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in inside]
    return tuple(sorted(found))


def in_tasks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df, written and dealt by key to tasks of about that many rows, to all cores at least: for tasks that wait for others to answer."""
    written = materialize(df, "asked")
    n, cores = written.count(), df.sparkSession.sparkContext.defaultParallelism
    return written.repartition(max(1, min(n, cores), -(-n // rows)), key)


#: Bytes of files whose rows one task of a costly step works on.
BYTES_A_TASK = 4 << 20


def spread(df: DataFrame, most: int = BYTES_A_TASK) -> DataFrame:
    """df, dealt to all cores at least and to a task for each ``most`` bytes of its files, if its input lies in fewer splits.

    For steps that cost much for each byte: a larger input has more tasks, not longer ones. It is
    exchanged once for this.
    """
    context = df.sparkSession.sparkContext
    size = 0
    for name in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    tasks = max(context.defaultParallelism, -(-size // most))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
