"""Quality classifier by compression.

One zstandard dictionary is trained from texts labelled good, one from texts labelled bad. A text
is compressed with each in pieces of ``PIECE`` bytes, a fresh frame for each, so that the
dictionaries weigh on all of it; the difference of the summed sizes over their sum tells which it
resembles, and its sizes in one frame over its length tell how much it repeats itself. Both are
measures of normalised compressed size, and a logistic curve fitted on labelled rows that the
dictionaries haven't seen makes them a probability.

Scale: fitting uses a bounded sample (``SAMPLE`` rows of each class, texts of any length), picked
by a hash of doc_id among all labelled rows, without moving other texts. Dictionaries are trained
from at most ``SAMPLE_CHARS`` characters of a text, of longer ones from segments spread over the
whole; the curve is fitted on measures of whole texts, taken where they lie. Scoring is one pass
without a shuffle; the model (under 300 KB) is broadcast.

Defined cases: a null text counts as empty and an empty text gets the score of its equal sizes; rows
with crc32(doc_id) mod 5 = 0 or null doc_id are held out of fitting; unlabelled rows and null
labels are not learned from; without rows of both classes every score is 0.5; an empty table
gives an empty result; other columns pass through ``filter_quality``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, fresh, own_columns

#: Labelled rows of each class that are fitted on, at most, and what of a text goes to the dictionaries.
SAMPLE = 1500
SAMPLE_CHARS = 20_000
#: Share of the sample that trains the dictionaries; the rest calibrates.
FOR_DICTIONARY = 2 / 3
DICTIONARY_BYTES = 112_640
SEGMENT = 1024
#: Bytes that are compressed at once: in longer frames the text's own past would displace the dictionary.
PIECE = 2048
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.weights = np.array(model.weights)
        raw = zstandard.DICT_TYPE_AUTO
        self.tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=raw),
                write_content_size=False, write_checksum=False, write_dict_id=False)
                for d in (model.good, model.bad)] if model.good and model.bad else []

    def features(self, text: str) -> tuple[float, float, float]:
        data = text.encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [data]
        good, bad = (sum(len(t.compress(p)) for p in pieces) for t in self.tools)
        whole = sum(len(t.compress(data)) for t in self.tools) if len(pieces) > 1 else bad + good
        return 1.0, (bad - good) / (bad + good), min(0.0, np.log(whole / 2 / max(len(data), 1)) - np.log(0.25))

    def score(self, text: str) -> float:
        if not self.tools:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -500, 500))))


def _dictionary(texts: list[str]) -> bytes:
    segments = [d[i : i + SEGMENT] for t in texts for d in [t.encode("utf-8", "surrogatepass")]
        for i in range(0, len(d), SEGMENT)]
    random.Random(1).shuffle(segments)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, segments[:4000], k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train from: the texts themselves
        return b"\n".join(segments)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic curve: Newton's method, each step halved until it lowers the loss."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + ridge * w @ w / 2)

    w, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if now - after < 1e-9:
            break
        w, now = w - step, after
    return tuple(map(float, w))


def _spread(text: str, chars: int) -> str:
    """The text, or of a longer one segments spread evenly over it."""
    if len(text) <= chars:
        return text
    n = max(1, chars // SEGMENT)
    starts = [(len(text) - SEGMENT) * i // max(n - 1, 1) for i in range(n)]
    return "".join(text[i : i + SEGMENT] for i in starts)


def _for_dictionary(n: int) -> int:
    return max(1, round(n * FOR_DICTIONARY))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled rows that aren't held out."""
    known = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id"),
        F.col("quality").cast("int").alias("quality")).distinct()
    there = docs.filter(~held_out() & F.col("text").isNotNull()).select("doc_id")
    near = known.join(there, "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    picked = {q: near.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(sample).collect() for q in (1, 0)}
    if not picked[1] or not picked[0]:
        return Model(b"", b"", (0.0, 0.0, 0.0))
    cut = {q: _for_dictionary(len(rows)) for q, rows in picked.items()}

    def rows_of(some: list, value) -> list:
        # at most 2 * sample ids, so the broadcast is bounded
        ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"], r["h"]) for r in some],
            "doc_id long, quality int, h long")
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(
            F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
        return sorted(texts.select("doc_id", "quality", "h",
                value("text").alias("value")).dropDuplicates(["doc_id", "quality"]).collect(),
                key=lambda r: (r["h"], r["doc_id"]))

    bounded_batches(docs.sparkSession)
    seen = rows_of([r for q in (1, 0) for r in picked[q][: cut[q]]],
        _column(lambda: lambda t: _spread(t, sample_chars), "string"))
    model = Model(*(_dictionary([r["value"] for r in seen if r["quality"] == q]) for q in (1, 0)), (0.0, 1.0, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = rows_of([r for q in (1, 0) for r in picked[q][cut[q] :] or picked[q]],
        _column(lambda: shared.value.scorer().features, "array<double>"))
    model.weights = _logistic(np.array([r["value"] for r in rest]), np.array([r["quality"] for r in rest], float))
    return model


def _column(make: Callable[[], Callable], kind: str):
    """A column function of texts; make() is called once in each task."""
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for part in parts:
            yield pd.Series([f(t or "") for t in part], dtype="float64" if kind == "double" else "object")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def _scored(docs: DataFrame, model: Model, threshold: float, names: tuple[str, str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    udf = _column(lambda: shared.value.scorer().score, "double")
    x = docs.withColumn(names[0], udf(F.col("text").cast("string")))
    return x.withColumn(names[1], F.when(F.col(names[0]) >= threshold, 1).otherwise(0))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    x = _scored(docs.select("doc_id", "text"), fit(docs, labels, **options), threshold, ("score", "predicted"))
    return x.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs that are predicted good, with their columns."""
    names = fresh(docs, "__score", "__predicted")
    x = _scored(docs, fit(docs, labels, **options), threshold, tuple(names))
    return x.filter(F.col(names[1]) == 1).select(*own_columns(docs))
