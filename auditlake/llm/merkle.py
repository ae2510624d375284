"""A Merkle manifest of a dataset: a node store by level, proofs of all rows, and their check.

A row is a leaf: the SHA-256 of its fields, a null as ``-``, any other as its UTF-8 byte count, a
colon and the value. Leaves stand in groups, in order inside a group; while a group has several
nodes, each run of ``FANOUT`` consecutive ones (the last may be shorter, down to one node) becomes
the hash of their hashes as hex text. What remains is the group's root, and the groups' roots, in
order of group, are the leaves of a tree of their own, whose remaining node is the root of all.

The store lies outside memory. Leaves are hashed where their rows are read, so that texts pass no
exchange, and written; sorted runs of them give each leaf its coordinate (group, place), which is
written too, so that nothing run again can change it. Each level is written as a Parquet table of
its own: it reads the one below and holds for each run its hash and its members' hashes, an eighth
of the rows. Proofs come by merge joins down the levels on the coordinate of the run, each level's
paths written before the next reads them; a path moves once for each run of leaves, never for each
leaf. All of it is built-in expressions.

Defined cases: a null field counts as said; null groups are one group and come first; null and
equal order values are ordered by the leaf's hash (equal leaves change nothing by changing
places); repeated rows are leaves of their own; a lone leaf is its group's root, and the root of a
single group is the root of all; the proof of a lone leaf of a lone group is the hash of nothing;
an empty table has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize

#: Nodes of a run.
FANOUT = 8
#: Bits that number a row inside its partition in monotonically_increasing_id.
_INSIDE = (1 << 33) - 1
_PATH = "array<struct<l:string,r:string>>"


@dataclass
class Tree:
    """leaves: (g, i, n, h, ...) with coordinate (g, i) and n leaves in the group; levels: (g, i, n, h, members) of the runs, from the lowest on."""

    leaves: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """(g, h, level) of each group's last node; level: of ``levels``, -1 if that is a leaf."""
        found = self.leaves.filter("n = 1").select("g", "h", F.lit(-1).alias("level"))
        for k, level in enumerate(self.levels):
            found = found.union(level.filter("n = 1").select("g", "h", F.lit(k)))
        return found


def field_hash(*fields: Column) -> Column:
    """Hash of the fields, each with its length, so that no two lists of fields are hashed as the same bytes."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def tree(rows: DataFrame, order: list[str]) -> Tree:
    """The tree over rows (g, h, ...): inside each group g, not null, by order, then by h. rows should be cheap or written."""
    leaves = materialize(_placed(rows, order), "merkle-leaves")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, below = [], leaves
    while largest > 1:
        run = F.floor(F.col("i") / FANOUT).cast("long")
        runs = below.filter("n > 1").groupBy("g", run.alias("i")).agg(F.max("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("i", "h"))).getField("h").alias("members"))
        runs = runs.select("g", "i", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"),
            F.sha2(F.array_join("members", ""), 256).alias("h"), "members")
        below = materialize(runs, f"merkle-level-{len(levels) + 1}")
        levels.append(below)
        largest = -(-largest // FANOUT)
    return Tree(leaves, levels)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the place in the group from 0, and n, the group's size: by sorted runs, never a group in one task."""
    keyed = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-rows")
    key = ["g", *order, "h", "__row"]
    runs = keyed.repartitionByRange(*key).sortWithinPartitions(*key).drop("__row")
    runs = materialize(runs.withColumn("__run", F.spark_partition_id()).withColumn("__at",
        F.monotonically_increasing_id().bitwiseAND(F.lit(_INSIDE))), "merkle-runs")
    # one row for each group of a run: as many as there are runs and groups
    parts = runs.groupBy("g", "__run").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    group = Window.partitionBy("g")
    before = F.sum("__size").over(group.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("g", "__run", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__size").over(group).alias("n"))
    return runs.join(parts, ["g", "__run"]).withColumn("i", F.col("__at") + F.col("__shift")).drop("__run", "__at",
        "__shift")


def paths(t: Tree, above: DataFrame) -> DataFrame:
    """t.leaves with what ``above`` (g, path, ...) says of their groups and path, their siblings from their own run up.

    above: for each group the path from its root on; an element of a path is the hashes to the left
    and to the right of the node in its run, each joined.
    """
    kept = [c for c in above.columns if c not in ("g", "path")]
    tops = t.roots().drop("h").join(above, "g")
    down = None
    for k in range(len(t.levels) - 1, -1, -1):
        level = t.levels[k]
        runs = level.filter("n = 1").join(tops.filter(F.col("level") == k).drop("level"), "g").select("g", "i",
            "members", "path", *kept)
        if down is not None:
            runs = runs.union(_stepped(level.filter("n > 1").select("g", "i", "members"), down, kept, ["members"]))
        # an eighth of the rows below; written, so that no plan holds more than one level and a lost executor costs no more
        down = materialize(runs, f"merkle-paths-{k + 1}")
    own = [c for c in t.leaves.columns if c not in ("g", "i", "n")]
    alone = t.leaves.filter("n = 1").join(tops.filter("level = -1").drop("level"), "g")
    found = alone.select("g", "i", *own, "path", *kept)
    if down is not None:
        found = found.union(_stepped(t.leaves.filter("n > 1").select("g", "i", *own), down, kept, own))
    return found


def _stepped(nodes: DataFrame, runs: DataFrame, kept: list[str], own: list[str]) -> DataFrame:
    """nodes (g, i, own...) with the path through their run: runs has (g, i, members, path, kept...)."""
    up = runs.select("g", F.col("i").alias("__run"), F.col("members").alias("__members"), "path", *kept)
    x = nodes.withColumn("__run", F.floor(F.col("i") / FANOUT).cast("long")).join(up, ["g", "__run"])
    at = (F.col("i") % FANOUT).cast("int")
    left = F.array_join(F.slice("__members", F.lit(1), at), "")
    right = F.array_join(F.slice("__members", at + 2, F.lit(FANOUT)), "")
    step = F.array(F.struct(left.alias("l"), right.alias("r")))
    return x.select("g", "i", *own, F.concat(step, F.col("path")).alias("path"), *kept)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["l"], node, step["r"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), ""), 256)


def manifest(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, h, ...) with i, path, subroot (the group's root) and root; g: the group, never null."""
    groups = tree(rows, order)
    joined = tree(groups.roots().select(F.lit("").alias("g"), "h", F.col("g").alias("group")), ["group"])
    top = joined.roots().select("g", F.array().cast(_PATH).alias("path"), F.col("h").alias("root"))
    above = paths(joined, top).select(F.col("group").alias("g"), "path", F.col("h").alias("subroot"), "root")
    return paths(groups, materialize(above, "merkle-groups"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and lang, place in it) of each document.

    The root is folded again from each row's own leaf and its siblings; where 3 divides the CRC-32 of
    doc_id as text, from the leaf of a tampered text, whose letters A to Z are lower-cased.
    """
    fields = lambda text: field_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text").cast("string")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = fields(text)
    # "" before all: the group of nulls
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"),
        leaf.alias("h"), "doc_id", "lang", F.when(touched, fields(lower)).alias("tampered"))
    x = manifest(rows, ["doc_id"])
    folded = fold(F.coalesce("tampered", "h"), F.col("path"))
    x = x.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"), "lang", F.col("i").alias("place"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))
