"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or of them is the document's score.

Only documents have labels. The gradient of the noisy-or shares a document's label out to its sentences by how likely each
is already to be the one, so the sentence model learns which of them offend, and then locates them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .labelled import SAMPLE_ROWS, sample, sigmoid
from .runtime import bound_batches, fold, materialize

DIMENSIONS, PIECE = 1 << 20, 5
STEPS, RATE, L1, START = 200, 1.0, 0.0005, -6.0
#: A feature is learned from if at least one in RARE toxic texts hold it (and two do), LIFT times as often as clean ones do.
RARE, LIFT = 100, 3.0
TASKS = 8
FOLDS, HELD_OUT = 5, 0
#: Fixed bytes that end a sentence.
ENDS = b".!?\n"

_ENDS = np.zeros(256, np.int64)
_ENDS[list(ENDS)] = 1


def sentences(part: tokens.Slice) -> np.ndarray:
    """The sentence of each word, counted over the slice without gaps; a text's end also ends its sentence."""
    if not len(part.starts):
        return np.zeros(0, np.int64)
    ended = np.cumsum(_ENDS[part.data])[part.starts]
    fresh = np.ones(len(ended), bool)
    of = part.text_of_word()
    fresh[1:] = (ended[1:] != ended[:-1]) | (of[1:] != of[:-1])
    return np.cumsum(fresh) - 1


def features(part: tokens.Slice, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature) pairs without repeats, in order, and the text of each sentence. Only features in the mask known.

    Features are hashes of whole words and of the PIECE-byte pieces of longer ones, for offence is also in parts of words.
    """
    sentence, of = sentences(part), part.text_of_word()
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    text = np.zeros(n, np.int64)
    text[sentence] = of
    mask = np.uint64(DIMENSIONS - 1)
    places, owners = (part.hashes & mask).astype(np.int64), sentence
    if len(part.data) >= PIECE and n:
        word = np.zeros(len(part.data) + 1, np.int64)
        word[part.starts] = 1
        word = np.cumsum(word)[:-1] - 1
        inside = tokens.LETTERS[part.data]
        run = np.concatenate([[0], np.cumsum(inside)])
        m = len(part.data) - PIECE + 1
        at = np.flatnonzero((run[PIECE:] - run[:m] == PIECE) & (word[PIECE - 1 :] == word[:m]))
        folded, packed = tokens.LOWER[part.data].astype(np.uint64), np.zeros(len(at), np.uint64)
        for k in range(PIECE):
            packed = (packed << np.uint64(8)) | folded[at + k]
        pieces = (tokens.mix64(packed + np.uint64(1)) & mask).astype(np.int64)
        places, owners = np.concatenate([places, pieces]), np.concatenate([sentence, sentence[word[at]]])
    if known is not None:
        keep = known[places]
        places, owners = places[keep], owners[keep]
    keys = np.unique(owners * DIMENSIONS + places)
    return keys // DIMENSIONS, keys % DIMENSIONS, text


def _associate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) to one row: how many texts with label 0 and 1 hold each feature, and how many there are."""
    counts, totals = np.zeros((2, DIMENSIONS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for part in tokens.slices(batch.column(1), tokens.LETTERS):
            sentence, place, text = features(part)
            labels = np.array(batch.column(2).slice(part.first, part.last - part.first).to_pylist(), np.int64)
            keys = np.unique(text[sentence] * DIMENSIONS + place)
            np.add.at(counts, (labels[keys // DIMENSIONS], keys % DIMENSIONS), 1)
            totals += np.bincount(labels, minlength=2)
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*counts, totals)], names=["clean", "toxic", "totals"])


def informative(clean: np.ndarray, toxic: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Features that enough toxic texts hold, and at a rate LIFT times that of clean texts."""
    enough = toxic >= max(2, int(totals[1]) // RARE)
    return enough & (toxic / max(int(totals[1]), 1) >= LIFT * (clean + 0.5) / max(int(totals[0]), 1))


def _featurize(known) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text, label) to (key, label, sentences, places, n): two lists of one length, and the number of sentences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(known.value, np.uint8)).view(bool)
        for batch in batches:
            for part in tokens.slices(batch.column(1), tokens.LETTERS):
                sentence, place, text = features(part, mask)
                n = part.last - part.first
                first = np.searchsorted(text, np.arange(n + 1))  # of each text's sentences
                offsets = pa.array(np.searchsorted(sentence, first).astype(np.int32))
                own = (sentence - first[text[sentence]]).astype(np.int32) if len(sentence) else sentence.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, n).cast(pa.string()),
                        batch.column(2).slice(part.first, n),
                        pa.ListArray.from_arrays(offsets, pa.array(own)),
                        pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
                        pa.array(np.diff(first).astype(np.int32)),
                    ],
                    names=["key", "label", "sentences", "places", "n"],
                )

    return run


def _chances(w: np.ndarray, sentence: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sentences the chance that it offends, by weights with the bias after the features and, from fit(), the floor.

    A sentence without a known feature is given the floor: none by fit(), or a text would offend by its length alone.
    Weights without a floor give it the bias.
    """
    p = sigmoid(np.bincount(sentence, w[place], minlength=n) + w[DIMENSIONS])
    if len(w) > DIMENSIONS + 1:
        p[np.bincount(sentence, minlength=n) == 0] = w[DIMENSIONS + 1]
    return p


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, int]], steps: int = STEPS) -> np.ndarray:
    """Weights of (label, sentences, places, number of sentences) rows: adaptive proximal gradient steps on the noisy-or's log loss over all rows.

    The penalty on weights grows to its full size over the first half, for at the start a word that offends shares its
    document's label with every sentence of it. Here the bias is that of all sentences; scores leave out those without a feature.
    """
    w = np.zeros(DIMENSIONS + 2)
    w[DIMENSIONS] = START
    rows = [r for r in rows if r[3]]
    labels = np.array([r[0] for r in rows], bool)
    if not labels.any() or not sum(len(r[2]) for r in rows):
        return w.astype(np.float32)
    sizes = [r[3] for r in rows]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    sentence = np.concatenate([r[1].astype(np.int64) + first for r, first in zip(rows, firsts, strict=False)])
    text = np.repeat(np.arange(len(rows)), sizes)
    used, place = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    v, seen, bias, bias_seen = np.zeros(len(used)), np.full(len(used), 1e-8), START, 1e-8
    for k in range(steps):
        p = sigmoid(np.bincount(sentence, v[place], minlength=len(text)) + bias)
        none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(rows))
        share = np.where(labels, -np.exp(none) / np.maximum(-np.expm1(none), 1e-12), 1.0)
        g = share[text] * p
        step = np.bincount(place, g[sentence], minlength=len(used))
        seen += step * step
        size = RATE / np.sqrt(seen)
        moved = v - size * step
        v = np.sign(moved) * np.maximum(np.abs(moved) - size * L1 * labels.sum() * min(1.0, 2 * k / steps), 0.0)
        bias_seen += g.sum() ** 2
        bias -= 0.2 * RATE * g.sum() / np.sqrt(bias_seen)
    w[used], w[DIMENSIONS] = v, bias
    return w.astype(np.float32)


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for k in range(batch.num_rows):
            rows.append((batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy(), batch.column(4)[k].as_py()))
    yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """Weights learned from at most ``rows`` labelled documents outside the held-out fold, in an order set by their ids."""
    found = materialize(sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows).repartition(TASKS), "toxicity-sample")
    counts = [np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64), np.zeros(2, np.int64)]
    for row in found.mapInArrow(_associate, "clean binary, toxic binary, totals binary").toLocalIterator():
        for total, piece, kind in zip(counts, row, (np.int32, np.int32, np.int64), strict=True):
            total += np.frombuffer(bytes(piece), kind)
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(informative(*counts)).tobytes())
    found = found.mapInArrow(_featurize(known), "key string, label int, sentences array<int>, places array<int>, n int")
    model = found.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", F.hash("places")).mapInArrow(_fit, "weights binary")
    row = model.first()  # none where no labelled document is left
    return bytes(row["weights"]) if row else fit([]).tobytes()


def _spans(part: tokens.Slice, sentence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in its text of each sentence's first word and the end of its last."""
    starts, ends = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    base = part.offsets[part.text_of_word()]
    np.minimum.at(starts, sentence, part.starts - base)
    np.maximum.at(ends, sentence, part.ends - base)
    return starts, ends


def _score(weights, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32).astype(np.float64)
        known = w[:DIMENSIONS] != 0
        for batch in batches:
            for part in tokens.slices(batch.column(1), tokens.LETTERS):
                sentence, place, text = features(part, known)
                n = part.last - part.first
                p = _chances(w, sentence, place, len(text))
                none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
                found: list[list] = [[] for _ in range(n)]
                bad = np.flatnonzero(p >= threshold)
                if len(bad):
                    starts, ends = _spans(part, sentences(part), len(text))
                    for k in bad.tolist():
                        found[text[k]].append({"start": int(starts[k]), "end": int(ends[k]), "score": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), pa.array(-np.expm1(none)), pa.array(np.bincount(text, minlength=n)), pa.array(found, pa.list_(span))],
                    names=["doc_id", "score", "n_sentences", "offending"],
                )

    return run


def score(docs: DataFrame, weights: bytes, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, n_sentences, offending) for each row of docs.

    offending lists the sentences that reach the threshold by themselves: byte offsets in the UTF-8 text, and score. Null
    and empty texts have no sentence and score 0.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, score double, n_sentences bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    return texts.mapInArrow(_score(spark.sparkContext.broadcast(weights), threshold), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op5 contract. Repeated rows score alike; a null doc_id is in no held-out fold (held_out false). Without labels
    every document scores 0; without documents there is no row."""
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
        F.array_max(F.transform("offending", lambda x: F.struct(x["score"], x["start"], x["end"]))).alias("worst"),
    )


def _clean(weights, text_at: int, threshold: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32).astype(np.float64)
        known = w[:DIMENSIONS] != 0
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for part in tokens.slices(batch.column(text_at), tokens.LETTERS):
                sentence, place, text = features(part, known)
                p = _chances(w, sentence, place, len(text))
                none = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=part.last - part.first)
                keep[part.first : part.last] = -np.expm1(none) < threshold
            yield batch.filter(pa.array(keep))

    return run


def keep_clean(docs: DataFrame, weights: bytes, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; null and empty texts stay."""
    bound_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(_clean(weights, docs.columns.index("text"), threshold), docs.schema)
