"""Embedding near-dedup by cross-polytope hashing.

A table turns a vector by fast Hadamard transforms with random signs and takes, for each of ``k``
turns, the signed coordinate that is largest: the nearest vertex of the cross-polytope. The
``k`` vertices are its home bucket. Multiprobe: a vector also looks into the buckets in which one
vertex is replaced by its second nearest. Vectors of a label that meet in a bucket are candidates,
and cosine in double precision decides.

``k`` follows the number of vectors of a length, so that chance company in a bucket stays the same
at every size, and the number of tables follows k: ``plan`` measures, on pairs made at the least
cosine that links, how often one table brings such a pair together, and takes as many tables as
find it with probability ``RECALL``. So the share of links found does not fall with the size. A
pair that meets in several buckets is counted in the first only, which both vectors' buckets tell
without any exchange.

Scale: equal vectors are one row; each is hashed once. Bucket rows are 17 bytes and carry no
vectors; buckets where nothing can meet go before vectors are joined. A bucket yields one row for
each linked member (its count of links, and an edge of a spanning forest), never its pairs;
buckets of over ``LARGE`` members are split into pairs of chunks, heavy ones before any exchange.
What stays quadratic is the number of cosines inside a group of near but unequal vectors: each
link is counted, so each is looked at.

Defined cases: a vector that is null, empty, zero or holds null, NaN or infinite components, and
one whose label is null, links with nothing and is its own component; vectors of different
lengths never link; a cosine of exactly the threshold links; a repeated row counts as another
vector; a null vec_id links but is no component's name unless all are null; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, materialize
from auditlake.llm.components import components
from auditlake.llm.runs import bounds, bucketed, dealt, looked_up, whole_runs

COSINE = 0.93
#: Share of pairs at the threshold that the tables find, as planned; nearer pairs are found more often.
RECALL = 0.99
LARGE = 8192
SEED = 7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def _fold(code: np.ndarray, value) -> np.ndarray:
    code = (code ^ np.asarray(value, np.uint64)) * _MIX
    return code ^ (code >> np.uint64(29))


def _padded(dim: int) -> int:
    """The power of two that vectors are padded to: in a few dimensions signs make few different turns."""
    return 1 << max(5, (dim - 1).bit_length())


def buckets(x: np.ndarray, labels: np.ndarray, k: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(home [n, tables], probes [n, tables, k]) bucket keys of the rows of x."""
    n, dim = x.shape
    d = _padded(dim)
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    home, probes = np.empty((n, tables), np.uint64), np.empty((n, tables, k), np.uint64)
    row = np.arange(n)
    for t in range(tables):
        vertex = np.empty((n, k, 2), np.uint64)
        for j in range(k):
            signs = np.random.default_rng([seed, t, j, d]).choice([-1.0, 1.0], (3, d))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            for rank in (0, 1):
                at = size.argmax(axis=1)
                vertex[:, j, rank] = at * 2 + (y[row, at] < 0)
                size[row, at] = -1
        start = _fold(_fold(np.full(n, 1, np.uint64), labels.astype(np.int64).view(np.uint64)), (dim << 20) + t + 1)

        def key(swap: int) -> np.ndarray:
            code = start
            for j in range(k):
                code = _fold(code, vertex[:, j, 1 if j == swap else 0] + np.uint64(1))
            return code

        home[:, t] = key(-1)
        for j in range(k):
            probes[:, t, j] = key(j)
    return home, probes


def _together(h1, p1, h2, p2) -> np.ndarray:
    """Whether two vectors meet in a table [pairs, tables]: one's home is the other's home or probe."""
    return (h1 == h2) | (h1[:, :, None] == p2).any(axis=2) | (h2[:, :, None] == p1).any(axis=2)


@lru_cache(maxsize=None)
def meeting_rate(dim: int, k: int, cosine: float = COSINE, seed: int = SEED, pairs: int = 4000,
        tables: int = 4) -> float:
    """How often one table brings two vectors of that cosine together, measured on random pairs."""
    if dim < 2:
        return 1.0
    r = np.random.default_rng([seed, dim, k])
    x, z = (r.normal(size=(pairs, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.linalg.norm(z, axis=1, keepdims=True)
    labels = np.zeros(pairs, np.int64)
    met = _together(*buckets(x, labels, k, tables, seed + 1), *buckets(y, labels, k, tables, seed + 1))
    # what the measure may be off by, three times its standard error, is taken off
    p = met.mean()
    return max(p - 3 * math.sqrt(p * (1 - p) / met.size), 1 / met.size)


def plan(dim: int, n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(k, tables) for n vectors of that length."""
    k = max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * _padded(dim)) - 0.1))
    p = meeting_rate(dim, k, cosine)
    return k, 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all have one length."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(plans: dict[int, tuple[int, int]], seed: int):
    """(class, home, probes): a vector's buckets by table, the probes of a table one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(3))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                k, tables = plans[int(dim)]
                home, probes = buckets(_matrix(part.column(2)), part.column(1).to_numpy(), k, tables, seed)
                n = part.num_rows
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.size // n), pa.int32()),
                        pa.array(x.reshape(-1).view(np.int64))) for x in (home, probes)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["class", "home", "probes"])

    return run


def _first_meeting(key, home, probes, i, j) -> np.ndarray:
    """Whether ``key`` (of each pair) is the first bucket in which vectors i and j meet: by table, then by key."""
    first = np.full(len(i), _NEVER, np.uint64)
    left = np.arange(len(i))
    for t in range(home.shape[1]):
        a, b = home[i[left], t], home[j[left], t]
        meet = np.where((a == b) | (a[:, None] == probes[j[left], t]).any(axis=1), a, _NEVER)
        meet = np.where((b[:, None] == probes[i[left], t]).any(axis=1), np.minimum(meet, b), meet)
        hit = meet != _NEVER
        first[left[hit]] = meet[hit]
        left = left[~hit]
        if not len(left):
            break
    return first == key


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each member is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


#: Buckets of at most so many members are compared all at once, member by distance.
SMALL = 24
#: Pairs that are looked at together.
AT_ONCE = 200_000


def _pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray,
        cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of the rows of one bucket with at least that cosine, in pieces of bounded size."""
    size = ends - starts
    small = np.repeat(size <= SMALL, size)
    bucket = np.repeat(np.arange(len(size)), size)
    for d in range(1, int(min(SMALL, size.max(initial=0)))):
        i = np.flatnonzero((bucket[:-d] == bucket[d:]) & small[d:])
        for at in range(0, len(i), AT_ONCE):
            a = i[at : at + AT_ONCE]
            a = a[np.einsum("ij,ij->i", x[a], x[a + d]) >= cosine]
            yield a, a + d
    for start, end in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        step = max(1, AT_ONCE // (end - start))
        for at in range(start, end - 1, step):
            i, j = np.nonzero(x[at : min(at + step, end)] @ x[at:end].T >= cosine)
            keep = i < j
            yield i[keep] + at, j[keep] + at


def _verify(plans: dict[int, tuple[int, int]], cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches):
            # keys are hashes: vectors of another length may fall into a bucket, and are left to theirs
            dims = np.array(runs.column("dim"))
            for dim in np.unique(dims):
                part = runs.filter(pa.array(dims == dim)).combine_chunks()
                k, tables = plans[int(dim)]
                n = part.num_rows
                starts, ends = bounds(part.column("key").to_numpy())
                own = part.column("bucket").to_numpy().view(np.uint64)  # the bucket, which a split bucket's key isn't
                ids, at_home, chunk, weight, labels = (part.column(c).to_numpy()
                    for c in ("class", "at_home", "chunk", "weight", "label"))
                codes = [np.asarray(part.column(c).combine_chunks().flatten()).view(np.uint64).reshape(shape) for c,
                    shape in (("home", (n, tables)), ("probes", (n, tables, k)))]
                counts, root = np.zeros(n, np.int64), np.arange(n)
                for i, j in _pairs(_matrix(part.column("embedding")), starts, ends, cosine):
                    fit = (at_home[i] | at_home[j]) & (labels[i] == labels[j])
                    # in a pair of chunks, only what lies in different ones: either has a bucket of its own
                    fit &= (chunk[i] != chunk[j]) | (chunk[i] < 0)
                    i, j = i[fit], j[fit]
                    if not len(i):
                        continue
                    root = _roots(n, np.r_[i, np.arange(n)], np.r_[j, root])
                    first = _first_meeting(own[i], *codes, i, j)
                    np.add.at(counts, i[first], weight[j[first]])
                    np.add.at(counts, j[first], weight[i[first]])
                linked = (counts > 0) | (root != np.arange(n))
                if linked.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(counts[linked]),
                            pa.array(ids[root[linked]])], ["class", "links", "root"])

    return run


def usable(docs: DataFrame):
    """Condition of vectors that can link."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, large: int = LARGE,
        seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    bounded_batches(vectors.sparkSession, 10_000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = rows.filter(usable(rows))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"),
        F.count(F.lit(1)).alias("weight"))
    # a class is named by its content, so that a name is the same whenever it is made
    classes = materialize(classes.select(F.xxhash64("label", "embedding").alias("class"), "label", "embedding",
            "least_id", "weight", F.size("embedding").alias("dim")), "classes")
    # as many rows as there are lengths of vectors
    plans = {r["dim"]: plan(r["dim"], r["count"], cosine, recall) for r in classes.groupBy("dim").count().collect()}
    hashed = materialize(classes.select("class", "label", "embedding", "dim").mapInArrow(_hash(plans, seed),
            "class long, home array<long>, probes array<long>"), "hashed")
    keys = hashed.select("class", F.explode("home").alias("key"),
        F.lit(True).alias("at_home")).union(hashed.select("class", F.explode("probes").alias("key"),
            F.lit(False).alias("at_home")))
    keys = keys.select("key", F.col("key").alias("bucket"), "class", "at_home")
    met = bucketed(keys, "class", large, keep=lambda w: F.max("at_home").over(w), chunk="chunk")
    met = met.join(classes.select("class", "weight", "label", "dim", "embedding").join(hashed, "class"), "class")
    met = met.select("key", "bucket", "class", "at_home", "chunk", "weight", "label", "dim", "embedding", "home",
        "probes")
    found = dealt(met).mapInArrow(_verify(plans, cosine), "class long, links long, root long")
    found = materialize(found, "found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node",
        "class")
    least = parts.join(classes.select("class", "least_id"), "class").groupBy("component")
    least = materialize(least.agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    parts = looked_up(parts, least, "component", "component", "n", {"component_id": "component_id"}, [F.col("class")])
    parts = parts.select("class", "component_id")
    known = classes.select("class", "least_id", "weight").join(links, "class", "left").join(parts, "class", "left")
    known = materialize(known.select("class", "weight",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id")), "known")
    named = good.select("vec_id", F.xxhash64("label", "embedding").alias("class"))
    linked = looked_up(named, known, "class", "class", "weight", {"n_links": "n_links", "component_id": "component_id"},
        [F.col("vec_id")]).drop("class")
    alone = rows.filter(~usable(rows)).select("vec_id", F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
