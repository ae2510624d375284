"""MinHash sketches of texts, banded lookup of similar ones, and their classes.

A sketch holds, for each of ``PERMUTATIONS`` hash functions, the least value over a text's shingles.
The share of equal places of two sketches estimates the Jaccard similarity of the texts; the
places' minima over several texts are the sketch of all their shingles, so sketches merge.

Banding: a sketch is cut into ``BANDS`` bands, and texts that agree in a whole band meet. With 32
bands of 4 places, two texts of similarity 0.85 miss each other with probability 5e-11, two of 0.3
meet with 0.23. Only hashes of bands are exchanged, never shingles.

Classes come in two steps, so that neither a bucket nor a class ever makes all its pairs. First
each text is compared with the smallest text of each of its buckets, and what is verified by the
exact index links the texts to components. Then only texts of one bucket that are in different
components can still bring two of them together: those outside the bucket's largest component are
compared with the bucket's texts of other components. A bucket whose texts are alike is done after
the first step, also on templated sites.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.clusters import classes
from auditlake.operators.membership import among, bitmaps
from auditlake.storage import materialize

PERMUTATIONS, BANDS = 128, 32
#: Shingles that are hashed at a time.
_AT_A_TIME = 32768


def hash_functions(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of n multiply-shift functions, by rule: the same in every run."""
    k = np.arange(2 * n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        k = (k ^ (k >> np.uint64(shift))) * np.uint64(factor)
    k ^= k >> np.uint64(31)
    return k[:n] | np.uint64(1), k[n:]


def sketch(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of minima for each set; shingles holds the sets one after another, starts where each begins. An empty set has the largest values."""
    factors, terms = hash_functions()
    sizes = np.diff(np.r_[starts, len(shingles)])
    out = np.full((PERMUTATIONS, len(starts)), 0xFFFFFFFF, np.uint64)
    owner = np.repeat(np.arange(len(starts)), sizes)
    for at in range(0, len(shingles), _AT_A_TIME):
        part, of = shingles[at : at + _AT_A_TIME].astype(np.uint64), owner[at : at + _AT_A_TIME]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sets, values = of[first], np.empty_like(part)
        # a function at a time: its values stay in the cache, and minima go along them
        for k in range(PERMUTATIONS):
            np.multiply(part, factors[k], out=values)
            values += terms[k]
            # a set may go on in the next part
            out[k, sets] = np.minimum(out[k, sets], np.minimum.reduceat(values, first) >> np.uint64(32))
    return np.ascontiguousarray(out.T)


def sketches(sets: DataFrame) -> DataFrame:
    """sets (..., set array<long>) with sketch array<long> in place of set."""
    kept = [c for c in sets.columns if c != "set"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema.fields if f.name != "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(kept))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            minima = sketch(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes)
            offsets = pa.array(np.arange(0, minima.size + 1, PERMUTATIONS), pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.array(minima.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], [*kept, "sketch"])

    return sets.select(*kept, "set").mapInArrow(run, f"{fields}, sketch array<bigint>")


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., sketch) of all the shingles of the rows (by..., sketch) of a group: minima, combined before any exchange."""
    least = [F.min(F.get("sketch", F.lit(k))) for k in range(PERMUTATIONS)]
    return rows.groupBy(*by).agg(F.array(*least).alias("sketch"))


def estimate(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two sketches tell; its standard error is 0.032 at 0.85."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / PERMUTATIONS


def banded(rows: DataFrame, bands: int = BANDS) -> DataFrame:
    """(band, ...) for each band of the rows (..., sketch): a hash of the band's number and values."""
    wide = PERMUTATIONS // bands
    key = lambda i: F.xxhash64(i, F.slice("sketch", i * wide + 1, wide))
    others = [c for c in rows.columns if c != "sketch"]
    return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), key)).alias("band"), *others)


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of pairs (a, b) those whose sets have that exact Jaccard similarity."""
    pairs = materialize(pairs, "candidates")
    texts = involved(texts, pairs)
    left = texts.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = texts.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.filter(F.col("common") >= similar * union - 1e-9).select("a", "b")


def involved(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts (id, ...) that written pairs (a, b) name, and a few others: the rest stays where it lies."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids-of-pairs")
    return among(texts, "id", bitmaps(ids, "id"))


def similar_classes(texts: DataFrame, similar: float) -> DataFrame:
    """(id, class) of texts (id, set), one row each: class is the smallest id that similar texts reach.

    texts is read several times and should be written; no two rows have the same id.
    """
    sized = texts.select("id", F.size("set").alias("n"), "set").filter("n > 0")
    sketched = materialize(sketches(sized), "sketches")
    meeting = banded(sketched)
    several = meeting.groupBy("band").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    members = materialize(meeting.join(several.drop("__n"), "band"), "bands")
    # sets of which the smaller has too few shingles can't be similar enough
    close = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similar - 1e-9
    sizes = sketched.select(F.col("id").alias("first"), F.col("n").alias("n_first"))
    stars = members.filter("id <> first").select("id", "n", "first").distinct().join(sizes, "first")
    stars = stars.filter(close(F.col("n"), F.col("n_first"))).select(F.col("first").alias("a"), F.col("id").alias("b"))
    linked = materialize(_verified(stars, texts, similar), "links")
    known = materialize(classes(linked), "classes")

    own = members.join(known.select(F.col("node").alias("id"), "class"), "id", "left").select("band", "id", "n",
        F.coalesce("class", "id").alias("class"))
    parts = own.groupBy("band", "class").agg(F.count(F.lit(1)).alias("__n"))
    largest = F.max(F.struct("__n", "class"))
    mixed = parts.groupBy("band").agg(largest.getField("class").alias("largest"), F.count(F.lit(1)).alias("__parts"))
    mixed = materialize(own.join(mixed.filter("__parts > 1").drop("__parts"), "band"), "mixed-bands")
    few = mixed.filter("class <> largest").select("band", F.col("id").alias("a"), F.col("n").alias("na"),
        F.col("class").alias("ca"))
    across = few.join(mixed.select("band", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("class").alias("cb")),
        "band").filter((F.col("ca") != F.col("cb")) & close(F.col("na"), F.col("nb")))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialize(_verified(across, texts, similar), "links")
    # a component stands for the links that made it
    found = known if more.isEmpty() else classes(known.select(F.col("node").alias("a"), F.col("class").alias("b")).union(more))
    return texts.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id",
        F.coalesce("class", "id").alias("class"))


def class_sizes(members: DataFrame) -> DataFrame:
    """members (doc, class, ...) with texts and rows, the different docs and the rows of their class."""
    each = members.groupBy("class", "doc").agg(F.count(F.lit(1)).alias("__n"))
    sizes = each.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.sum("__n").alias("rows"))
    return members.join(sizes, "class")

