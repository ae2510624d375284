"""A crawl's tables under one commit.

    data/<snapshot>/<table>/        what a writer has written, Parquet
    commits/<crawl>/<version>.json  the tables of a crawl: where each lies, its rows and its schema

A writer puts all its tables into a folder of its own, which nothing refers to, and then makes the
next version of the crawl's commit, a file that names them: written beside, and moved to its name
in one step that fails if the name is taken. Readers take the last version that there is. So a
reader has all tables of a commit or all of the one before; a writer that stops leaves nothing that
can be seen; of two writers that began from the same version the second gets ``Conflict``. Tables
that a commit doesn't write stay as the version before has them.

Works on any file system of Hadoop that moves a file to a free name atomically.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Table = DataFrame | Callable[[], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def versions(self, crawl_id: int) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.root}/commits/{crawl_id}") if n.endswith(".json")]

    def crawls(self) -> list[int]:
        return sorted(map(int, self._names(f"{self.root}/commits")))

    def commit_of(self, crawl_id: int, version: int | None = None) -> dict:
        """What a version says, the last one if none is named; {} if there is none."""
        known = self.versions(crawl_id)
        if not known or version is not None and version not in known:
            return {}
        path = self._path(f"{self.root}/commits/{crawl_id}/{version or known[-1]:09d}.json")
        stream = self._files.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, crawl_id: int, tables: Mapping[str, Table], since: int | None = None) -> int:
        """Write the tables and make the crawl's next version of them. since: the version that they were made from, the last one if not said."""
        known = self.versions(crawl_id)
        since = since if since is not None else known[-1] if known else 0
        before = self.commit_of(crawl_id, since).get("tables", {}) if since else {}
        snapshot, written = uuid.uuid4().hex, {}
        try:
            for name, table in tables.items():
                rows = table if isinstance(table, DataFrame) else table()
                seen = Observation()
                path = f"{self.root}/data/{snapshot}/{name}"
                rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(path)
                written[name] = {"path": path, "rows": seen.get["rows"], "schema": rows.schema.jsonValue()}
            said = {"crawl": crawl_id, "version": since + 1, "snapshot": snapshot, "tables": before | written}
            self._publish(f"{self.root}/commits/{crawl_id}", f"{since + 1:09d}.json", json.dumps(said))
        except BaseException:
            self._files.delete(self._path(f"{self.root}/data/{snapshot}"), True)
            raise
        return since + 1

    def _publish(self, folder: str, name: str, text: str) -> None:
        beside = self._path(f"{self.root}/beside/{uuid.uuid4().hex}")
        self._files.mkdirs(self._path(folder))
        stream = self._files.create(beside, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        never_over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        never_over[0] = hadoop.Options.Rename.NONE
        target = self._path(f"{folder}/{name}")
        try:
            hadoop.FileContext.getFileContext(self._files.getUri(), self._conf).rename(beside, target, never_over)
        except Exception as e:
            self._files.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{target} is there") from None
            raise

    def read(self, crawl_id: int, table: str, version: int | None = None) -> DataFrame:
        found = self.commit_of(crawl_id, version).get("tables", {}).get(table)
        if found is None:
            raise LookupError(f"crawl {crawl_id} has no table {table}" + f" in version {version}" * (version is not None))
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(found["path"])

    def contents(self, crawl_id: int, version: int | None = None) -> DataFrame:
        """(crawl_id, version, name, rows) of a version's tables, from its commit alone."""
        said = self.commit_of(crawl_id, version)
        rows = [(crawl_id, said["version"], name, t["rows"]) for name, t in sorted(said.get("tables", {}).items())]
        return self.spark.createDataFrame(rows, "crawl_id long, version int, name string, rows long")

    def forget(self, crawl_id: int, keep: int = 1) -> list[str]:
        """Remove all but the last ``keep`` versions of a crawl, and the snapshots that none of its versions names any more."""
        known = self.versions(crawl_id)
        named = lambda versions: {t["path"].rsplit("/", 2)[1] for v in versions for t in self.commit_of(crawl_id, v)["tables"].values()}
        kept, gone = known[-keep:], known[:-keep]
        unused = sorted(named(gone) - named(kept))
        for version in gone:
            self._files.delete(self._path(f"{self.root}/commits/{crawl_id}/{version:09d}.json"), False)
        for snapshot in unused:
            self._files.delete(self._path(f"{self.root}/data/{snapshot}"), True)
        return unused
