"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

N-grams of up to two words come from two readings of a text: its words, and their shapes (case, digits, closing marks,
length, whether the word repeats one of the two before it), which carry over to words that no labelled text has. A score is
one sparse dot product with weights of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .labelled import SAMPLE_ROWS, sample, sigmoid
from .runtime import bound_batches, fold

DIMENSIONS = 1 << 18
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.02, 0.5
FOLDS, HELD_OUT = 3, 1
U = np.uint64

_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = 1


def shapes(part: tokens.Slice) -> np.ndarray:
    """A small code for each word's form."""
    if not len(part.starts):
        return np.zeros(0, np.uint64)
    lengths = part.ends - part.starts
    bounds = np.concatenate([[0], np.cumsum(tokens.SPACE[part.data], dtype=np.int64)])
    inside = part.data[tokens.SPACE[part.data]]
    firsts = bounds[part.starts]
    upper, lower, digit = (np.add.reduceat(x[inside], firsts) for x in (_UPPER, _LOWER, _DIGIT))
    other = lengths - upper - lower - digit
    last = part.data[part.ends - 1].astype(np.uint64)
    last[tokens.LETTERS[part.data[part.ends - 1]]] = 0
    code = np.minimum(upper, 3).astype(np.uint64) * U(4) + np.minimum(lower, 3).astype(np.uint64)
    code = (code * U(3) + np.minimum(digit, 2).astype(np.uint64)) * U(4) + np.minimum(other, 3).astype(np.uint64)
    code = (code * U(256) + last) * U(8) + np.minimum(lengths // 3, 7).astype(np.uint64)
    of, h = part.text_of_word(), part.hashes
    again = np.zeros(len(h), np.uint64)
    for back in (2, 1):
        again[back:][(h[back:] == h[:-back]) & (of[back:] == of[:-back])] = back
    return code * U(3) + again


def features(part: tokens.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) sorted by text and feature. A value is the root of the n-gram's share of its reading."""
    of, sizes = part.text_of_word(), np.diff(part.word_offsets)
    texts, places = [], []
    shape = shapes(part)
    for reading, words in enumerate((part.hashes, tokens.mix64(shape + U(1)))):
        for n in (1, 2):
            ok = tokens.gram_ok(part, n)
            grams = tokens.mix64(tokens.grams(words, n) + U(2 * reading + n))[ok]
            texts.append(of[: len(ok)][ok])
            places.append((grams & U(DIMENSIONS - 1)).astype(np.int64))
    keys, counts = np.unique(np.concatenate(texts) * DIMENSIONS + np.concatenate(places), return_counts=True)
    text = keys // DIMENSIONS
    return text, keys % DIMENSIONS, np.sqrt(counts / np.maximum(sizes[text], 1))


def _featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) to (key, label, places, values)."""
    for batch in batches:
        for part in tokens.slices(batch.column(1)):
            text, place, value = features(part)
            n = part.last - part.first
            offsets = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(part.first, n).cast(pa.string()),
                    batch.column(2).slice(part.first, n),
                    pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                ],
                names=["key", "label", "places", "values"],
            )


class Ftrl:
    """Per-coordinate follow-the-regularised-leader, proximal form; the last coordinate is the constant."""

    def __init__(self, size: int = DIMENSIONS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ values) - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of (label, places, values) rows seen in this order, epochs times; float32, DIMENSIONS + 1."""
    model = Ftrl()
    for _ in range(epochs):
        for label, at, values in rows:
            model.learn(np.append(at, DIMENSIONS), np.append(values, 1.0), label)
    return model.weights().astype(np.float32)


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for k in range(batch.num_rows):
            rows.append((batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()))
    yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """Weights learned from at most ``rows`` labelled documents outside the held-out fold.

    Their n-grams, not their texts, go to one task, which sees them in an order set by their ids: reruns agree.
    """
    found = sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    found = found.mapInArrow(_featurize, "key string, label int, places array<int>, values array<float>")
    order = [F.xxhash64("key"), "key"]
    model = found.repartition(1).sortWithinPartitions(*order).mapInArrow(_fit, "weights binary")
    row = model.first()  # none where no labelled document is left
    return bytes(row["weights"]) if row else fit([]).tobytes()


def _score(weights) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32).astype(np.float64)
        for batch in batches:
            for part in tokens.slices(batch.column(1)):
                text, place, value = features(part)
                n = part.last - part.first
                z = np.bincount(text, w[place] * value, minlength=n) + w[DIMENSIONS]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, n), pa.array(sigmoid(z))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: bytes) -> DataFrame:
    """(doc_id, score) for each row of docs. Null and empty texts, which have no n-grams, get the score of the constant."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(spark)
    return texts.mapInArrow(_score(spark.sparkContext.broadcast(weights)), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 contract. Repeated rows score alike; a null doc_id is in no held-out fold (held_out false). Without labels
    every score is 0.5."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
