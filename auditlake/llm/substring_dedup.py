"""Substring dedup by difference-cover anchors.

Every residue modulo ``PERIOD`` is a difference of two members of the cover, so any two places of
texts have an offset below the period at which both are cover places. Short windows are hashed
at cover places only (6 of 31): whenever two documents share a run of ``window`` words, they
share an anchor inside it. Each anchor that more than one document holds is then extended to the
full windows around it, and these are compared by 96 bits of hash of all their words. A window
that starts in a document with a smaller doc_id too has its words removed.

Scale: nothing pairs documents. Anchors and windows meet by hash, each needs the smallest doc_id
of its hash only, so a passage in n documents makes n rows a window, not n * n. A task settles
what it can before the exchange: of a passage that a third of all documents share it sends the
places of one or two of its documents to the passage's task, the others are dealt by document.
Texts are shuffled once by row (both joins reuse the exchange); anchors are about a fifth of the
words.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing;
repeats inside one document stay; a row with null doc_id neither loses words nor makes others
lose any; rows with the same doc_id are one document to others, whose windows no row of it makes
repeats, and each keeps its own text and places; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, materialize
from auditlake.llm.packed import exchanged, later, settle_later, settle_shared, shared

WINDOW = 50
#: A difference set: each number from 1 to 30 is one difference of two members modulo 31.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
_SEEDS = (11, 23)


class Words:
    """The words of a text and where each run of them stands in the joined text."""

    def __init__(self, text: str):
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1) - 1
        self.starts = np.r_[0, self.ends[:-1] + 1] if self.n else self.ends

    def hashes(self, places: np.ndarray, length: int, seed: int) -> np.ndarray:
        digest, joined = xxhash.xxh3_64_intdigest, self.joined
        pairs = zip(self.starts[places].tolist(), self.ends[places + length - 1].tolist())
        return np.fromiter([digest(joined[a:b], seed) for a, b in pairs], np.uint64, len(places))


def _anchors(window: int, period: int, cover: tuple[int, ...]):
    length = window - period + 1

    def find(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = Words(text.as_py() or "")
            if words.n >= window:
                at = (np.arange(0, words.n, period)[:, None] + np.array(cover)).reshape(-1)
                at = at[at <= words.n - length]
                yield words.hashes(at, length, 0), np.zeros(len(at), np.uint32), np.full(len(at), doc,
                    np.int64), np.full(len(at), row, np.int32), at.astype(np.int32)

    return find


def _windows(window: int, period: int):
    def find(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for doc, row, text, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                batch.column(3)):
            words = Words(text.as_py() or "")
            if words.n < window:
                continue
            at = np.array(shared.as_py(), np.int64)
            at = at[at <= words.n]
            # windows that contain the anchor start at most period - 1 words before it
            opens = np.zeros(words.n + 2, np.int64)
            np.add.at(opens, np.maximum(at - period + 1, 0), 1)
            np.add.at(opens, at + 1, -1)
            at = np.flatnonzero(np.cumsum(opens)[: words.n - window + 1] > 0)
            yield words.hashes(at, window, _SEEDS[0]), words.hashes(at, window,
                _SEEDS[1]).astype(np.uint32), np.full(len(at), doc, np.int64), np.full(len(at), row,
                np.int32), at.astype(np.int32)

    return find


def _cut(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, places in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if places.is_valid:
                    at = np.array(places.as_py(), np.int64)
                    at = at[at <= n - window]
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    gone = np.cumsum(steps[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _numbered(texts: DataFrame) -> DataFrame:
    """(doc_id, row, text): row tells unlike texts of one doc_id apart; it is 0 where a doc_id has one row."""
    twice = materialize(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"),
        "repeated-ids")
    name = F.xxhash64("text")
    unlike = texts.join(twice, "doc_id", "left_semi").select("doc_id", name.alias("name")).distinct()
    unlike = materialize(unlike.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))),
        "unlike-texts")
    unlike = unlike.select(F.col("doc_id").alias("__id"), "name", "row")
    return texts.join(unlike, (F.col("doc_id") == F.col("__id")) & (name == F.col("name")), "left").select("doc_id",
        F.coalesce("row", F.lit(0)).alias("row"), "text")


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
        keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and with ``keep_text`` the text that is left, as kept."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or window < period:
        raise ValueError("cover must have each difference modulo period, which is at most window")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = texts.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"))
    texts = _numbered(texts.filter("doc_id is not null"))  # in both joins, so that they read one exchange of the texts
    # buckets of the exchange: enough to spread evenly over the partitions
    bits = max(10, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    own = ["doc_id", "row"]
    gathered = lambda x, f: x.mapInArrow(f,
        "doc_id long, row int, place int").groupBy(*own).agg(F.collect_list("place").alias("places"))
    places = gathered(exchanged(texts, _anchors(window, period, cover), bits, settle_shared), shared)
    windows = exchanged(texts.join(places, own).select("doc_id", "row", "text", "places"), _windows(window, period),
        bits, settle_later)
    repeated = gathered(windows, later)
    columns = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    cut = texts.join(repeated, own, "left").select("doc_id", "text", "places").mapInArrow(_cut(window, keep_text),
        columns)
    return cut.union(nameless.mapInArrow(_cut(window, keep_text), columns))
