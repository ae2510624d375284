"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

The words to take are shared among the sources by weight; a source that would pass its
maximum number of epochs is clamped there and what it can't take is shared among the others
by weight, until none is above. That end state has a closed form: with the sources in order of
cap over weight, some first ones are clamped, and the others have one level times their
weight, so one pass over the sources (not the rows) finds it.

A source's target is then taken as whole repetitions of all its documents and one fractional
repetition: the documents in seeded random order, up to the one at which the taken words are
nearest to the target.

Scale: rows are shuffled once, without texts, by (source, bucket of the seeded order); a source
that holds a third of all rows is spread over ``BUCKETS`` keys. The running sum of a source comes
from prefix sums over the buckets and a window inside each bucket. ``mix`` carries whole rows
through the same one exchange.

Defined cases: a null or empty text has size 0 and is taken 0 times its size; a null source is a
source of its own, last in order; an empty table gives an empty result; each row counts by itself,
also those that share a doc_id or are wholly equal; equal levels of water are sources in order of
their names; extra columns pass through ``mix``, whatever their names, and are ignored by
``allocation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import own_columns

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 4096
SEED = "mix-1"


def word_count(text):
    """Number of words ``[^\\x20\\x09-\\x0D]+``: white space runs after a non-space mark word ends."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.translate(squeezed, " \t\n\u000b\f\r", "")), F.lit(0)).cast("long")


def _order(seed: str):
    """Seeded order of documents, 0 <= h < 2**60: from doc_id, so that reruns and other engines agree."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over rows (sn, sk, source_size), one for each source: adds target.

    sn tells that the source is null, sk is its name. The windows run over sources, of which
    there are few beside rows.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("sn", "sk")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    x = x.withColumn("words", F.sum("source_size").over(everything).cast("double") * share)
    # sources in order of the level at which they are full; before: those that are full earlier
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), "sn", "sk")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * max_epochs)
    x = x.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    # the level if exactly the earlier ones are full; the first that stays below its cap sets it
    x = x.withColumn("level", (F.col("words") - F.col("full")) / F.col("open"))
    x = x.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                F.struct(F.col("cap") / F.col("weight"), F.col("sn"), F.col("sk"),
                    F.col("level")))).over(everything)["level"])
    return x.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")),
            F.col("cap"))).select("sn", "sk", "source_size", "target")


def _keyed(docs: DataFrame, seed: str, buckets: int, rows: bool) -> DataFrame:
    """What places a row; with rows also the row itself, as one struct, so that its names clash with none here."""
    own = [F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(docs))]).alias("row")] if rows else []
    x = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        _order(seed).alias("h"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), *own)
    return x.select("*", F.col("source").isNull().alias("sn"), F.coalesce("source", F.lit("")).alias("sk"),
        (F.col("h") % buckets).cast("int").alias("bucket"))


def _allocated(docs: DataFrame, rows: bool, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    parts = _keyed(docs, seed, buckets, False).groupBy("sn", "sk", "bucket").agg(F.sum("size").alias("part"))
    goal = targets(parts.groupBy("sn", "sk").agg(F.sum("part").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("sn", "sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("part").over(before), F.lit(0)))
    plan = parts.join(goal, ["sn", "sk"]).select("sn", "sk", "bucket", "earlier", "source_size", "target")
    inside = Window.partitionBy("sn", "sk", "bucket").orderBy("h", "doc_id", "size",
        "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    x = _keyed(docs, seed, buckets, rows).join(plan, ["sn", "sk", "bucket"])
    start = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    x = x.withColumn("whole", whole.cast("long")).withColumn("rest",
        F.col("target") - F.col("whole") * F.col("source_size"))
    return x.withColumn("times", F.col("whole") + F.when((F.col("size") > 0) & (F.col("whole") < max_epochs)
            & (start + F.col("size") / 2.0 < F.col("rest")), 1).otherwise(0))


def allocation(docs: DataFrame, **options) -> DataFrame:
    """Return (doc_id, source, size, source_size, target, times, taken), one row for each document."""
    return _allocated(docs, False, **options).select("doc_id", "source", "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: each row as often as ``allocation`` says, with its own columns; rows without words are not taken."""
    x = _allocated(docs, True, **options).filter("times > 0 and size > 0")
    x = x.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return x.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
