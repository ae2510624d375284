"""Connected components of a distributed edge list, by alternating large and small stars.

Each round hangs nodes nearer to the smallest node around them; rounds grow with the logarithm
of the longest chain. Edges stay distributed, no round makes more rows than it has edges (twice,
before duplicates go), and each round is written to the shared folder, which cuts the lineage.
Nodes with one in a thousand of all edges, a thousand of them at most, are broadcast, so that the
edges of a star's middle go to no one task; a round of few edges is broadcast as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import discard, materialize
from auditlake.llm.runs import HEAVY


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (u, v), ``total`` of them at most, with m, the least v of their u."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    heavy = F.col("n") * HEAVY >= total
    few = least.filter(heavy).select(F.col("u").alias("hu"), F.col("m").alias("hm"))
    x = rows.join(F.broadcast(few), F.col("u") == F.col("hu"), "left")
    # edges of heavy nodes are dealt by themselves; what they might meet there doesn't count
    x = x.withColumn("key", F.when(F.col("hu").isNotNull(), F.xxhash64(F.lit("own"), "u", "v")).otherwise(F.col("u")))
    rest = least.filter(~heavy).select(F.col("u").alias("lu"), F.col("m").alias("lm"))
    return x.join(rest, F.col("key") == F.col("lu"), "left").select("u", "v", F.coalesce("hm", "lm").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), longs; component is the smallest node reachable."""
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialize(ends.distinct(), "edges")
    state = _state(now)
    while True:
        total = 2 * state[0]
        near = _with_least(now.union(now.select("v", "u")), total).withColumn("m", F.least("u", "m"))
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = _with_least(large, total)
        small = hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(hung.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now, last, state = now, after, state, _state(after)
        discard(before)
        if state == last:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select("v", "v").distinct())
