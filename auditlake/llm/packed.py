"""Places in documents that meet by hash, exchanged in packed form and read in sorted order.

A row of the exchange holds all places of one bucket (the top bits of the hash) that a task has
found among some hundred thousand: hashes, and differences of doc_ids, rows and places, which
compress well. Before the exchange a task decides what it can by itself, so that of a hash
which a third of all rows share it sends a few rows: the rest are dealt by document. After the
exchange rows are unpacked and sorted by the JVM, which spills, and read as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Places that a task gathers before it packs them.
GATHER = 400_000
_PACKED = "bucket int, known boolean, h binary, g binary, docs binary, rows binary, places binary"
_PLAIN = "known boolean, h long, g int, doc_id long, row int, place int"
_NAMES = ["known", "h", "g", "doc_id", "row", "place"]


def _pack(parts: list[tuple[np.ndarray, ...]], bits: int, settle) -> pa.RecordBatch:
    h, g, docs, rows, places = (np.concatenate([p[i] for p in parts]) for i in range(5))
    known = settle(h, g, docs)
    top = np.uint64(64 - bits)
    spread = docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = np.where(known, spread, h) >> top
    h[known], g[known] = 0, 0  # nobody reads them any more
    kind = bucket * np.uint64(2) + known
    order = np.argsort(kind.astype(np.uint16) if bits < 15 else kind, kind="stable")
    kind, h, g, docs, rows, places = (x[order] for x in (kind, h, g, docs, rows, places))
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.empty(0, np.int64)
    pieces = list(zip(starts.tolist(), np.r_[starts[1:], len(kind)].astype(int).tolist()))
    step = lambda x: np.diff(x, prepend=x.dtype.type(0)).tobytes()
    packed = [*(pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (h, g)),
        *(pa.array([step(x[a:b]) for a, b in pieces], pa.binary()) for x in (docs, rows, places))]
    kind = kind[starts].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array((kind >> 1).astype(np.int32)), pa.array((kind & 1).astype(bool)),
            *packed], ["bucket", "known", "h", "g", "docs", "rows", "places"])


def _groups(h: np.ndarray, g: np.ndarray, docs: np.ndarray):
    """(order by hash, starts of the hashes, number of each row's hash, documents), in that order."""
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1, docs[order]


def settle_later(h, g, docs) -> np.ndarray:
    """A place is later for sure if the task itself has its hash in a smaller document."""
    order, starts, run, d = _groups(h, g, docs)
    known = np.zeros(len(h), bool)
    if len(h):
        known[order] = d > np.minimum.reduceat(d, starts)[run]
    return known


def settle_shared(h, g, docs) -> np.ndarray:
    """A place is shared for sure if the task itself has its hash in two documents.

    One place of the least and one of the greatest document stay open, to tell other tasks' places.
    """
    order, starts, run, d = _groups(h, g, docs)
    out = np.zeros(len(h), bool)
    if len(h):
        least, most = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
        known = (least != most)[run]
        for end in (least, most):  # the first place of that document
            at = np.flatnonzero(known & (d == end[run]))
            known[at[np.r_[True, run[at][1:] != run[at][:-1]][: len(at)]]] = False
        out[order] = known
    return out


def packing(find, bits: int, settle):
    """find: batch -> lists of (h uint64, g uint32, docs int64, rows int32, places int32), equally long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in find(batch):
                parts.append(part)
                held += len(part[0])
                if held >= GATHER:
                    yield _pack(parts, bits, settle)
                    parts, held = [], 0
        if held:
            yield _pack(parts, bits, settle)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            read = lambda i, kind: [np.frombuffer(x.as_py(), kind) for x in rows.column(i)]  # noqa: E731, B023
            h, g, docs, own, places = read(2, np.int64), read(3, np.int32), read(4, np.int64), read(5,
                np.int32), read(6, np.int32)
            known = np.repeat(np.array(rows.column(1)), [len(x) for x in h])
            summed = [[np.cumsum(x, dtype=x.dtype) for x in c] for c in (docs, own, places)]
            yield pa.RecordBatch.from_arrays([pa.array(known), *(pa.array(np.concatenate(x)) for x in (h, g, *summed))],
                _NAMES)


def exchanged(rows: DataFrame, find, bits: int, settle) -> DataFrame:
    """(known, h, g, doc_id, row, place), the open rows of a hash together and by doc_id."""
    packed = rows.mapInArrow(packing(find, bits, settle), _PACKED).repartition("bucket")
    return packed.mapInArrow(_unpack, _PLAIN).sortWithinPartitions("h", "g", "doc_id")


#: What the readers below hand on: (doc_id, row, place).
_PLACE = [3, 4, 5]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """(rows, whether they are known), no batch of both."""
    for batch in batches:
        known = batch.column(0)
        n = known.true_count
        if n:
            yield batch.filter(known), True
        if n < batch.num_rows:
            yield batch.filter(pc.invert(known)) if n else batch, False


def _runs(batch: pa.RecordBatch):
    h, g, docs = (batch.column(i).to_numpy() for i in (1, 2, 3))
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
    return (int(h[0]), int(g[0])), (int(h[-1]), int(g[-1])), np.flatnonzero(new), np.cumsum(new) - 1, docs


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, place) of the rows whose hash a smaller doc_id has too."""
    key, least = None, 0
    for batch, known in _open(batches):
        if known:
            yield batch.select(_PLACE)
            continue
        first, last, starts, run, docs = _runs(batch)
        leasts = docs[starts].copy()
        if first == key:
            leasts[0] = least
        key, least = last, int(leasts[-1])
        yield batch.select(_PLACE).filter(pa.array(docs > leasts[run]))


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, place) of the rows whose hash another doc_id has too."""
    key, least, open_, held = None, 0, False, []
    for batch, known in _open(batches):
        if known:
            yield batch.select(_PLACE)
            continue
        first, last, starts, run, docs = _runs(batch)
        leasts = docs[starts].copy()
        goes_on = first == key
        if goes_on:
            leasts[0] = least
        many = np.logical_or.reduceat(docs != leasts[run], starts)
        if goes_on and open_:
            many[0] = True
        if goes_on and many[0]:
            yield from held
        if not goes_on or many[0] or len(starts) > 1:
            held = []
        if not many[-1]:  # one doc_id so far
            held.append(batch.select(_PLACE).slice(int(starts[-1])))
        key, least, open_ = last, int(leasts[-1]), bool(many[-1])
        yield batch.select(_PLACE).filter(pa.array(many[run]))
