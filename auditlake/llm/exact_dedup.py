"""Exact dedup by counting quotient filters.

Each partition's fingerprints go into a counting quotient filter. A fingerprint's high bits are its
quotient, the home slot, its low bits the remainder. Remainders of one quotient form a run in
ascending order, runs stand in order of their quotients, each at its home or after the run before;
one bit for each quotient tells whether it has a run, one bit for each slot whether a run ends
there. Counts lie in the slots too: twice the remainder for two, and for more a digit between the
two, which a value below the remainder gives away. Filters are read in the order of fingerprints
and so merge without loss by merging sorted remainders and adding counts. Fingerprints with a
count above one are routed to byte verification: their texts are grouped by all of their bytes, so
a collision of fingerprints can't join different texts. All others are unique.

Scale: filters are exchanged in blocks, one for each range of quotients; there are as many blocks
as keep one under ``PER_BLOCK`` fingerprints, whatever the groups are like: a text that a third
of the rows share is one remainder with a count. Texts of repeated fingerprints are grouped with
partial aggregation, so copies meet as one row for each task; rows of the largest groups find
theirs in a broadcast of a thousand rows at most, so none are sent to one task.

Defined cases: a null text counts as empty, and empty texts equal each other; a null doc_id is
larger than any other; rows that repeat a doc_id and text are the same document and share its
fate; an empty table gives an empty result; other columns pass through ``filter_exact``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import SPACE, fresh, materialize, no_nulls, own_columns
from auditlake.llm.runs import looked_up

#: Fingerprints of a block, about, if all are distinct.
PER_BLOCK = 1 << 19
#: Blocks at least and at most; powers of two.
FEWEST, MOST = 1 << 6, 1 << 20
_BLOCK_SCHEMA = "block int, quotient_bits int, occupied binary, run_ends binary, slots binary"
_FIELDS = ["block", "quotient_bits", "occupied", "run_ends", "slots"]


def normalized(text: str = "text"):
    return F.regexp_replace(no_nulls(text), SPACE, " ")


class QuotientFilter:
    """A counting quotient filter of fingerprints of ``bits`` bits.

    A count is one digit, since remainders have at least ``LEAST_REMAINDER`` bits and counts fewer.
    """

    LEAST_REMAINDER = 40

    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, run_ends: np.ndarray, slots: np.ndarray):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_ends, self.slots = occupied, run_ends, slots

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """The filter of distinct fingerprints in ascending order with their counts."""
        # a twentieth of the slots stays free, counts aside
        quotient_bits = min(bits - cls.LEAST_REMAINDER, max(1, int(len(values) * 1.05).bit_length()))
        low = np.uint64(bits - quotient_bits)
        x = values & ((np.uint64(1) << low) - np.uint64(1))
        c = counts.astype(np.uint64)
        digit = np.where(c > 2, c - np.uint64(2), np.uint64(1))  # never 0
        digit = np.where((x > 0) & (digit >= x), digit + np.uint64(1), digit)  # and never the remainder
        many = c > 2
        marked = many & (x > 0) & (digit > x)  # a digit above the remainder needs a 0 before it
        zeros = many & (x == 0)  # the remainder 0 has nothing below it: 0, digit, 0, 0
        need = np.where(many, 3, c.astype(np.int64)) + marked + zeros
        at = np.cumsum(need) - need
        slots = np.repeat(x, need)
        slots[at[many & ~marked] + 1] = digit[many & ~marked]
        slots[at[marked] + 1] = 0
        slots[at[marked] + 2] = digit[marked]
        # where each run starts: at home, or after the runs before it
        quotient = (values >> low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else np.empty(0, np.int64)
        home, before = quotient[first], at[first]
        start = before + np.maximum.accumulate(home - before)
        length = np.diff(np.r_[before, len(slots)])
        size = int(start[-1] + length[-1]) if len(first) else 0
        placed = np.zeros(size, np.uint64)
        placed[np.repeat(start - before, length) + np.arange(len(slots))] = slots
        occupied, run_ends = np.zeros(1 << quotient_bits, bool), np.zeros(size, bool)
        occupied[home] = True
        run_ends[start + length - 1] = True
        return cls(bits, quotient_bits, occupied, run_ends, placed)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints in ascending order, counts)."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        start = np.maximum(home, np.r_[0, end[:-1] + 1]) if len(end) else home
        length = end - start + 1
        within = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        x, run = self.slots[within], np.repeat(np.arange(len(home)), length)
        if not len(x):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        same_run = np.r_[run[1:] == run[:-1], False]
        following = np.r_[x[1:], np.uint64(0)]
        # a run that only rises and has no 0 holds each remainder once or twice; others hold counts
        odd_runs = np.zeros(len(home), bool)
        odd_runs[run[same_run & (following < x)]] = True
        odd_runs[run[x == 0]] = True
        odd = odd_runs[run]
        twice = same_run & (following == x)
        head = ~np.r_[False, twice[:-1]] & ~odd
        values, counts, runs = x[head], 1 + twice[head].astype(np.int64), run[head]
        if odd.any():
            read = [(v, n, r) for r in np.flatnonzero(odd_runs) for v,
                n in self._counted(self.slots[start[r] : end[r] + 1].tolist())]
            values = np.concatenate([values, np.array([i[0] for i in read], np.uint64)])
            counts = np.concatenate([counts, np.array([i[1] for i in read], np.int64)])
            runs = np.concatenate([runs, np.array([i[2] for i in read], np.int64)])
        fps = (home[runs].astype(np.uint64) << np.uint64(self.bits - self.quotient_bits)) | values
        order = np.argsort(fps, kind="stable")
        return fps[order], counts[order]

    @staticmethod
    def _counted(run: list[int]) -> Iterator[tuple[int, int]]:
        """(remainder, count) of a run with counts in it."""
        i, n = 0, len(run)
        while i < n:
            x, more = run[i], run[i + 1 : i + 4]
            if x == 0:
                if len(more) == 3 and more[0] and not more[1] and not more[2]:
                    yield 0, more[0] + 2
                    i += 4
                else:  # a single one or two; more have a digit
                    k = 2 if more[:1] == [0] else 1
                    yield 0, k
                    i += k
            elif more and more[0] < x:
                digit, used = (more[0], 3) if more[0] else (more[1], 4)
                yield x, digit - (digit > x) + 2
                i += used
            else:
                k = 2 if more[:1] == [x] else 1
                yield x, k
                i += k

    def packed(self) -> tuple[int, bytes, bytes, bytes]:
        """(quotient bits, occupied, run ends, slots), a slot in as many bytes as a remainder needs."""
        width = (self.bits - self.quotient_bits + 7) // 8
        slots = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return self.quotient_bits, np.packbits(self.occupied).tobytes(), np.packbits(
            self.run_ends).tobytes(), slots.tobytes()

    @classmethod
    def unpacked(cls, bits: int, quotient_bits: int, occupied: bytes, run_ends: bytes, slots: bytes) -> QuotientFilter:
        width = (bits - quotient_bits + 7) // 8
        n = len(slots) // width
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(slots, np.uint8).reshape(n, width)
        bit = lambda b, k: np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool)
        return cls(bits, quotient_bits, bit(occupied, 1 << quotient_bits), bit(run_ends, n),
            whole.reshape(-1).view("<u8").astype(np.uint64))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge (ascending values, counts), adding the counts of equal values."""
    values, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(values, kind="stable")  # merges runs that are already sorted
    values, counts = values[order], counts[order]
    if not len(values):
        return values, counts
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.add.reduceat(counts, starts)


def _low_bits(blocks: int) -> int:
    """Bits of a fingerprint inside its block."""
    if blocks < 2 or blocks & (blocks - 1) or blocks > MOST:
        raise ValueError(f"blocks must be a power of two from 2 to {MOST}")
    return 65 - int(blocks).bit_length()


def _build(blocks: int, at_once: int = 1_000_000):
    bits = _low_bits(blocks)
    low = (np.uint64(1) << np.uint64(bits)) - np.uint64(1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's filter, block by block; fingerprints are taken in by runs, so that memory follows distinct ones."""
        known = (np.empty(0, np.uint64), np.empty(0, np.int64))
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(waiting[-1])
            if held >= at_once:
                new, n = np.unique(np.concatenate(waiting), return_counts=True)
                known, waiting, held = _merged([known, (new, n.astype(np.int64))]), [], 0
        if waiting:
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            known = _merged([known, (new, n.astype(np.int64))])
        values, counts = known
        block = (values >> np.uint64(bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(values) else []
        rows = [(int(block[a]), *QuotientFilter.of(values[a:b] & low, counts[a:b], bits).packed()) for a,
            b in zip(starts, np.r_[starts[1:], len(values)].astype(int))]
        for at in range(0, len(rows), 1024):
            part = list(zip(*rows[at : at + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()),
                    *(pa.array(c, pa.binary()) for c in part[2:])], _FIELDS)

    return build


def _merge_blocks(blocks: int):
    bits = _low_bits(blocks)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; holds one merged block at a time."""
        at, parts = 0, []

        def repeated() -> pa.RecordBatch:
            values, counts = _merged(parts)
            many = counts > 1
            fps = (np.uint64(at) << np.uint64(bits)) | values[many]
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(counts[many])], ["fp", "n"])

        for batch in batches:
            for block, *filter_ in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at and parts:
                    yield repeated()
                    parts = []
                at = block
                parts.append(QuotientFilter.unpacked(bits, *filter_).items())
                if len(parts) >= 64:
                    parts = [_merged(parts)]
        if parts:
            yield repeated()

    return merge


def blocks_for(rows: int) -> int:
    """A power of two, so that no block has many more than ``PER_BLOCK`` of so many fingerprints."""
    return min(MOST, max(FEWEST, 1 << (rows // PER_BLOCK).bit_length()))


def repeated_fingerprints(fingerprints: DataFrame, blocks: int) -> DataFrame:
    """(fp, n) of the fingerprints in the one long column whose count is above one."""
    built = fingerprints.mapInArrow(_build(blocks), _BLOCK_SCHEMA)
    dealt = built.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(_merge_blocks(blocks), "fp long, n long")


def exact_groups(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(fp, sha, keep_id, group_size) of each group of two or more equal texts, verified byte by byte."""
    text = normalized()
    blocks = blocks or blocks_for(docs.count())
    repeated = materialize(repeated_fingerprints(docs.select(F.xxhash64(text).alias("fp")), blocks), "repeated")
    routed = docs.select("doc_id", text.alias("body")).withColumn("fp", F.xxhash64("body"))
    same = routed.join(repeated.select("fp"), "fp", "left_semi")
    groups = same.groupBy("body").agg(F.min("doc_id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return materialize(groups.select(F.xxhash64("body").alias("fp"),
            F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "keep_id", "group_size"), "groups")


def exact_dedup(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Return (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs."""
    groups = exact_groups(docs, blocks)
    rows = docs.select("doc_id", F.sha2(normalized().cast("binary"), 256).alias("sha"))
    x = looked_up(rows, groups, "sha", "sha", "group_size", {"keep_id": "keep_id", "group_size": "group_size"},
        [F.col("doc_id")])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return x.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size",
            F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"),
            F.col("sha").alias("text_sha256"))


def filter_exact(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    mine, keep, size = fresh(docs, "__mine", "__keep", "__size")
    x = docs.withColumn(mine, F.sha2(normalized().cast("binary"), 256))
    # a merge join at every size: the groups grow with the data
    x = looked_up(x, exact_groups(docs, blocks), mine, "sha", "group_size", {"keep_id": keep, "group_size": size},
        [F.col("doc_id")], merge=True)
    return x.filter(F.col(size).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))).select(*own_columns(docs))
