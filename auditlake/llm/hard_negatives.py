"""Hard negatives by vantage-point trees over norm-augmented vectors.

Components are scaled and rounded down to integers, so scores are exact integer inner products.
With one more component, sqrt(M - |x|^2) where M is the largest squared norm, all rows lie on a
sphere, and an anchor, which gets 0 there, has squared distance |q|^2 + M - 2 q.x from a row: the
higher the score, the nearer. A window of scores is an annulus around the anchor, and the best rows
in a window are the nearest in its annulus.

An upper tree of vantage points, fitted on a bounded sample (``SAMPLE_ROWS``), deals all rows to
cells; each cell keeps, from all its rows, the least and largest distance to the vantage points
above it. By the triangle inequality an anchor goes only to cells that its annulus can touch. A
cell is cut into blocks of bounded size, each task builds a tree over a block, down to leaves, and
anchors of a batch visit its leaves nearest first, each until the next leaf lies outside the
annulus or beyond the last row kept. Bounds of distances only spare work: scores decide, so the
result is exact.

First the positives are searched, with an annulus that ends at the k-th best row of the label in
the sample, then the negatives, with the annulus of each positive. Blocks meet batches by two
keys, both bounded; what a block finds is at most k rows for each anchor.

Defined cases: rows with a null id, label or vector, or with null, NaN or infinite components, take
no part, nor do rows whose squared norm after scaling exceeds 2^52 (scores would not be exact); a
shorter vector, also an empty one, counts as continued by zeros; rows with the anchor's id are not
its others; a repeated row counts as often as it is there, also as anchor; ties go to the smaller
id; an anchor without others of its label, and a positive whose window is empty (always where its
score is negative), give no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import discard, materialize

#: Rows that the upper tree is fitted on, at most.
SAMPLE_ROWS = 4096
#: Rows of a cell that the upper tree aims at, and its levels, at most.
CELL_ROWS, CELL_LEVELS = 4096, 10
#: Rows of a block and anchors of a batch that meet in a task, at most (as far as a hash deals evenly).
BLOCK_ROWS, BATCH_ANCHORS = 1 << 15, 1 << 13
#: Rows of a leaf.
LEAF_ROWS = 256
#: Scores of anchors and rows that are held at a time.
SCORES = 1 << 22
#: The largest squared norm: all products and sums are whole numbers that a double holds.
MAX_NORM = 1 << 52
#: Relative error of distances, generously; bounds are widened by it.
_EPS = 1e-6
_LOW, _HIGH = -(1 << 62), 1 << 62


class Vantage:
    """A vantage-point tree over points; node k has the children 2k + 1 and 2k + 2, the cells are its lowest level."""

    def __init__(self, points: np.ndarray, levels: int):
        """points: with their augmenting component. Each node splits its points by the median distance to one of them."""
        self.levels, self.points, self.middle = levels, np.zeros((2**levels - 1, points.shape[1])), np.zeros(2**levels - 1)
        parts = {0: points}
        for k in range(2**levels - 1):
            own = parts.pop(k)
            if not len(own):
                parts[2 * k + 1] = parts[2 * k + 2] = own
                continue
            # the point farthest from the first one: at the rim its distances spread most
            self.points[k] = own[int(np.argmax(_distances(own[:1], own)[0]))]
            d = _distances(self.points[k : k + 1], own)[0]
            self.middle[k] = np.median(d)
            parts[2 * k + 1], parts[2 * k + 2] = own[d <= self.middle[k]], own[d > self.middle[k]]

    def path(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each point, its distances to the vantage points above its cell)."""
        at, found = np.zeros(len(points), np.int64), np.empty((len(points), self.levels))
        for level in range(self.levels):
            found[:, level] = np.sqrt(np.maximum(0, ((points - self.points[at]) ** 2).sum(axis=1)))
            at = 2 * at + 1 + (found[:, level] > self.middle[at])
        return at - (2**self.levels - 1), found


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0, square))


def _augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.c_[vectors, np.sqrt(np.maximum(0, most - (vectors * vectors).sum(axis=1)))]


def _annulus(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, farthest distance) of rows with low <= score <= high, widened by the error of distances."""
    base = (vectors * vectors).sum(axis=1) + most
    slack = _EPS * np.maximum(base, 1)
    near = np.sqrt(np.maximum(0, base - 2.0 * high - slack))
    return near * (1 - _EPS) - 1e-6, np.sqrt(np.maximum(0, base - 2.0 * low + slack)) * (1 + _EPS) + 1e-6


class Block:
    """A vantage-point tree over a block's rows, in leaves of ``LEAF_ROWS``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        order = np.argsort(ids, kind="stable")
        points = _augmented(vectors[order], most)
        leaves, vantage = [], []  # leaf: its rows, and for each vantage point above its number, least and largest distance
        stack: list[tuple[np.ndarray, list]] = [(np.arange(len(order)), [])]
        while stack:
            own, above = stack.pop()
            if len(own) <= LEAF_ROWS:
                leaves.append((np.sort(own), above))
                continue
            far = own[int(np.argmax(_distances(points[own[:1]], points[own])[0]))]
            d = _distances(points[far : far + 1], points[own])[0]
            half = len(own) // 2
            split = np.argpartition(d, half)
            for side in (split[:half], split[half:]):
                stack.append((own[side], [*above, (len(vantage), d[side].min(), d[side].max())]))
            vantage.append(points[far])
        self.vantage = np.array(vantage).reshape(-1, points.shape[1])
        self.leaves = [(ids[order][rows], labels[order][rows], vectors[order][rows]) for rows, _ in leaves]
        self.above = [above for _, above in leaves]

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest distance) that a leaf's rows can have from each anchor."""
        d = _distances(np.c_[vectors, np.zeros(len(vectors))], self.vantage) if len(self.vantage) else None
        least, largest = np.zeros((len(vectors), len(self.leaves))), np.full((len(vectors), len(self.leaves)), np.inf)
        for k, above in enumerate(self.above):
            for v, low, high in above:
                least[:, k] = np.maximum(least[:, k], np.maximum(low - d[:, v], d[:, v] - high))
                largest[:, k] = np.minimum(largest[:, k], d[:, v] + high)
        return least, largest

    def nearest(self, own: np.ndarray, labels: np.ndarray, same: bool, vectors: np.ndarray, low: np.ndarray, high: np.ndarray,
            k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, id, score): each anchor's first k rows with low <= score <= high, of its label but not its id, or of others."""
        near, far = _annulus(vectors, low, high, most)
        least, largest = self.bounds(vectors)
        # leaves that the annulus doesn't touch are not visited
        least = np.where((largest * (1 + _EPS) + 1e-6 < near[:, None]) | (least * (1 - _EPS) - 1e-6 > far[:, None]), np.inf, least)
        order = np.argsort(least, axis=1, kind="stable")
        n, floor = len(vectors), low.copy()
        found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        waiting = np.arange(n)
        for step in range(len(self.leaves)):
            bound = least[waiting, order[waiting, step]]
            reach = _annulus(vectors[waiting], floor[waiting], high[waiting], most)[1]
            waiting = waiting[bound * (1 - _EPS) - 1e-6 <= reach]
            if not len(waiting):
                break
            leaf_of, new = order[waiting, step], []
            for leaf in np.unique(leaf_of):
                ids, kinds, rows = self.leaves[leaf]
                at = waiting[leaf_of == leaf]
                for part in range(0, len(at), max(1, SCORES // len(ids))):
                    q = at[part : part + max(1, SCORES // len(ids))]
                    score = vectors[q] @ rows.T
                    ok = (score >= floor[q][:, None]) & (score <= high[q][:, None])
                    if same:
                        ok &= (kinds == labels[q][:, None]) & (ids != own[q][:, None])
                    else:
                        ok &= kinds != labels[q][:, None]
                    i, j = np.nonzero(ok)
                    new.append((q[i], ids[j], score[i, j].astype(np.int64)))
            found = _first(tuple(np.concatenate([x, *more]) for x, *more in zip(found, *new)), k)
            # whoever has k rows needs no row below the last of them; one as good may have a smaller id
            place, count = np.unique(found[0], return_counts=True)
            last = np.cumsum(count) - 1
            floor[place[count == k]] = found[2][last[count == k]]
        return found


def _first(rows: tuple, k: int) -> tuple:
    """Of rows (place, id, score) the first k of each place, by score, then by id."""
    place, name, score = rows
    order = np.lexsort((name, -score, place))
    place, name, score = place[order], name[order], score[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
    return place[rank < k], name[rank < k], score[rank < k]


def _matrix(column, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, shorter ones continued by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(rows: DataFrame, scale: int, label: Column) -> DataFrame:
    """(id, label, v, norm) of the rows that take part; v: the scaled whole numbers; label as a number that is equal where labels are."""
    number = lambda x: F.floor(x.cast("double") * scale)
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**31)))
    x = whole.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"),
        label.cast("string").alias("__label"), F.transform("embedding", number).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y)
    x = x.filter("__label is not null").withColumn("norm", squares).filter(F.col("norm") <= MAX_NORM)
    return x.select("id", F.xxhash64("__label").alias("label"), "v", "norm")


def hard_negatives(rows: DataFrame, label: Column | None = None, scale: int = 256, anchors: Column | None = None,
        positives: int = 5, negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    For each anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels with low_percent <= 100 * their score / the positive's <= 100.
    label: instead of the column; anchors: which ids are anchors, all those divisible by 100 if not said.
    """
    spark = rows.sparkSession
    use = materialize(usable(rows, scale, F.col("label") if label is None else label), "negatives-rows")
    n, most, width, n_anchors = use.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v")),
        F.count(F.when(_is_anchor(anchors), 1))).first()
    most, width = most or 0.0, max(1, width or 1)
    # a bounded sample, the same at every run: the smallest hashes of the ids
    sample = use.select("id", "label", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    vectors = _matrix(sample.column("v"), width)
    levels = min(CELL_LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / CELL_ROWS)))))
    top = spark.sparkContext.broadcast((Vantage(_augmented(vectors, most), levels), sample.column("id").to_numpy(),
        sample.column("label").to_numpy(), vectors))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, labels, of = top.value
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            cell, path = tree.path(_augmented(x, most))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"),
                pa.array(cell.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], names=["id", "label", "v", "cell",
                "path"])

    dealt = materialize(use.select("id", "label", "v").mapInArrow(placed,
        "id long, label long, v array<long>, cell int, path array<double>").withColumn("row",
        F.monotonically_increasing_id()), "negatives-cells")
    discard(use)
    # one row for each cell, 2^CELL_LEVELS at most
    edges = [f(F.col("path")[k]).alias(f"{name}{k}") for k in range(levels) for name, f in (("low", F.min), ("high", F.max))]
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges).collect()}
    blocks = {c: -(-r["n"] // BLOCK_ROWS) for c, r in cells.items()}
    ranges = np.array([[c, blocks[c], *(r[f"{name}{k}"] for k in range(levels) for name in ("low", "high"))]
        for c, r in sorted(cells.items())]).reshape(len(cells), 2 + 2 * levels)
    batches_of = max(1, -(-n_anchors // BATCH_ANCHORS))

    def units(queries: Iterator[pa.RecordBatch], same: bool) -> Iterator[pa.RecordBatch]:
        """Each query, once for each block of the cells that its annulus can touch; that of a positive starts at the sample's k-th best."""
        tree, ids, labels, of = top.value
        for batch in queries:
            x = _matrix(batch.column("v"), width)
            high, low = batch.column("high").to_numpy(), batch.column("low").to_numpy()
            if same:
                low = _sample_floor(x, batch.column("id").to_numpy(), batch.column("label").to_numpy(), ids, labels, of,
                    positives)
            near, far = _annulus(x, low.astype(float), high.astype(float), most)
            touch = np.ones((len(x), len(ranges)), bool)
            if levels:
                d = _distances(_query(x), tree.points)
                for k, r in enumerate(ranges):
                    node = int(r[0]) + 2**levels - 1
                    for level in range(levels - 1, -1, -1):
                        node = (node - 1) // 2
                        least, largest = r[2 + 2 * level], r[3 + 2 * level]
                        v = d[:, node]
                        touch[:, k] &= (np.maximum(least - v, v - largest) * (1 - _EPS) - 1e-6 <= far) & (
                            (v + largest) * (1 + _EPS) + 1e-6 >= near)
            q, c = np.nonzero(touch)
            count = ranges[c, 1].astype(np.int64)
            q, c = np.repeat(q, count), np.repeat(c, count)
            number = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
            out = batch.select(["row", "positive", "id", "label", "v", "high"]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(low[q]), pa.array(ranges[c, 0].astype(np.int32)),
                pa.array(number.astype(np.int32))], names=[*out.schema.names, "low", "cell", "block"])

    def searched(queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, positive, found, score, and id of the anchor) of each block's first k rows for each query."""
        spread = queries.mapInArrow(lambda x: units(x, same), "row long, positive long, id long, label long, v array<long>, high long, low long, "
            "cell int, block int").withColumn("batch", F.pmod(F.xxhash64("row", "positive"), F.lit(batches_of)).cast("int"))
        table = spark.createDataFrame([(c, b) for c, b in blocks.items()], "cell int, blocks int")
        own = dealt.join(F.broadcast(table), "cell").select("id", "label", "v", "cell", F.pmod(F.xxhash64("row"),
            "blocks").cast("int").alias("block"))
        own = own.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches_of - 1))))
        schema = "row long, positive long, found long, score long"

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            kinds = pa.schema([(c, pa.int64()) for c in ("row", "positive", "found", "score")])
            if not left.num_rows or not right.num_rows:
                return kinds.empty_table()
            number = lambda t, c: t.column(c).to_numpy()
            block = Block(number(left, "id"), number(left, "label"), _matrix(left.column("v"), width), most)
            place, name, score = block.nearest(number(right, "id"), number(right, "label"), same, _matrix(right.column("v"), width),
                number(right, "low"), number(right, "high"), k, most)
            return pa.table([number(right, "row")[place], right.column("positive").to_numpy(zero_copy_only=False)[place], name,
                score], schema=kinds)

        keys = ("cell", "block", "batch")
        return own.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(search, schema)

    own = dealt.filter(_is_anchor(anchors)).select("row", "id", "label", "v")
    first = own.select("row", F.lit(-1).cast("long").alias("positive"), "id", "label", "v", F.lit(_LOW).alias("low"),
        F.lit(_HIGH).alias("high"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "found")
    pairs = searched(first, True, positives).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives)
    pairs = materialize(pairs.select("row", F.col("n").alias("positive"), F.col("found").alias("positive_id"), F.col("score").alias(
        "positive_score")), "negatives-positives")
    windows = pairs.filter("positive_score >= 0").join(own, "row").select("row", F.col("positive").cast("long").alias("positive"), "id", "label", "v",
        F.ceil(F.col("positive_score") * low_percent / F.lit(100)).cast("long").alias("low"), F.col("positive_score").alias(
        "high"))
    found = searched(windows, False, negatives)
    best = Window.partitionBy("row", "positive").orderBy(F.desc("score"), "found")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    names = own.select("row", F.col("id").alias("anchor_id"))
    return found.join(pairs, ["row", "positive"]).join(names, "row").select("anchor_id", "positive_id", F.col("rank").cast(
        "int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _is_anchor(anchors: Column | None) -> Column:
    return F.col("id") % 100 == 0 if anchors is None else anchors


def _query(vectors: np.ndarray) -> np.ndarray:
    """Anchors have 0 in the augmenting component."""
    return np.c_[vectors, np.zeros(len(vectors))]


def _sample_floor(x: np.ndarray, own: np.ndarray, kinds: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray,
        k: int) -> np.ndarray:
    """The k-th best score of each anchor among the sample's other rows of its label: the k best of all rows have no lower one."""
    score = np.where((kinds[:, None] == labels) & (own[:, None] != ids), x @ of.T, _LOW)
    if score.shape[1] < k:
        return np.full(len(x), _LOW)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k].astype(np.int64)
