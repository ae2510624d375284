"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into ``distance + 3`` blocks. Two fingerprints that differ in at
most ``distance`` bits agree in at least three whole blocks, so they share the bucket of one
choice of three blocks; in each bucket the Hamming distance is verified. No close pair is lost.

Scale: equal fingerprints are one row before any join, so exact copies never meet as pairs. A
bucket yields a spanning forest of its links (fewer edges than members), not its pairs; buckets
of over ``LARGE`` members are split into pairs of chunks, heavy ones before any exchange; rows of a
heavy fingerprint find their component in a broadcast of a thousand rows at most. Texts are read once and never shuffled;
what is shuffled is 16 bytes for each fingerprint and choice of blocks. With three of seven
blocks a bucket stands for about 27 bits, so chance company stays rare up to 10**8 fingerprints.

Defined cases: a null text counts as empty; a text without words has fingerprint zero, one with
fewer words than a shingle hashes its whole sequence; repeated rows share a fingerprint and so a
component; a null doc_id is no component's smallest unless all are null; an empty table gives an
empty result; other columns pass through ``filter_near``, whatever their names. There a row goes by
its doc_id and own text: unlike texts under the same or a null doc_id stay. Repeated rows of the smallest id
all stay, and so do rows of a component whose ids are all null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, fresh, materialize, no_nulls, own_columns
from auditlake.llm.components import components
from auditlake.llm.runs import bounds, bucketed, dealt, looked_up, whole_runs

WORDS = 4
DISTANCE = 4
SEED = 42
LARGE = 32_768
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PIECE = 1 << 15


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of the lower-cased text's word shingles, repeats included."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(found) - words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())],
        np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        part = hashes[at : at + _PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _text_hash():
    return F.xxhash64(no_nulls())


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp), fp as a signed long; text_hash names a row's text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))],
                ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        _text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks(distance: int) -> list[int]:
    n = distance + 3
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(a | b | c) for a, b, c in combinations(blocks, 3)]


def forest(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links of at most ``distance`` bits connect: each value is searched from once."""
    out, left = [], values
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                queue.extend(found)
                left = left[~near]
    return out


def _link(distance: int, small: int = 8):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in whole_runs(batches):
            key = runs.column(0).to_numpy()
            fp = runs.column(1).to_numpy().view(np.uint64)
            starts, ends = bounds(key)
            size = ends - starts
            edges = []
            big = np.repeat(size > small, size)
            for d in range(1, int(min(small, size.max()))):
                near = (key[:-d] == key[d:]) & ~big[d:] & (np.bitwise_count(fp[:-d] ^ fp[d:]) <= distance)
                edges.append((fp[:-d][near], fp[d:][near]))
            for a, b in zip(starts[size > small], ends[size > small]):
                edges += forest(fp[a:b], distance)
            if edges:
                a, b = (np.concatenate([e[i] for e in edges]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, large: int = LARGE) -> DataFrame:
    """Edges (a, b) that connect the fingerprints in column fp exactly as all links of at most ``distance`` bits do."""
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(distance))]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    return dealt(bucketed(rows, "fp", large)).mapInArrow(_link(distance), "a long, b long")


def _grouped(fps: DataFrame, distance: int, large: int) -> DataFrame:
    """fps (doc_id, fp, ...) with component_id."""
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")),
        "classes")
    found = components(links(classes.select("fp"), distance, large)).withColumnsRenamed({"node": "fp"})
    least = found.join(classes, "fp").groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = found.join(least, "component").select("fp", "component_id")
    each = classes.join(linked, "fp", "left").select("fp", "n",
        F.coalesce("component_id", "least_id").alias("component_id"))
    each = materialize(each, "components")
    return looked_up(fps, each, "fp", "fp", "n", {"component_id": "component_id"},
        [F.col("doc_id"), F.col("text_hash")])


def near_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED,
        large: int = LARGE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of docs."""
    return _grouped(materialize(fingerprints(docs, words, seed), "fingerprints"), distance, large)


def simhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id)."""
    x = near_groups(docs, **options)
    return x.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def filter_near(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component those with the smallest doc_id."""
    gone_id, gone_hash, mine = fresh(docs, "__gone", "__of", "__mine")
    gone = near_groups(docs, **options).filter("not doc_id <=> component_id").select(F.col("doc_id").alias(gone_id),
        F.col("text_hash").alias(gone_hash)).distinct()
    gone = materialize(gone, "gone")
    x = docs.withColumn(mine, _text_hash())
    # a merge join at every size: what goes grows with the data
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(mine) == F.col(gone_hash))
    return x.join(gone.hint("merge"), own, "left_anti").select(*own_columns(docs))
