"""Quality by a factorisation machine.

Features of a document are its hashed words (shares of all words), statistics of its
structure and its length. The machine adds a weight per feature and, for every pair of
features, the product of two low-rank vectors; by the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

a document is scored in time linear in its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows
from .shared import column_bytes, map_arrow, slices, word_hashes, words

WORD_BITS, RANK = 16, 8
EPOCHS, RATE, DECAY = 12, 0.05, 1e-4
SIGNS = b"!#$%&*|?@:;,.-_/\\\"'()[]{}<>=+~^`"
STATISTICS = 14 + len(SIGNS)


@dataclass
class Model:
    """Bias, weights and vectors of the hashed words followed by those of the statistics, and the statistics' mean and deviation."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def score(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> np.ndarray:
        n = len(statistics)
        x = (statistics - self.mean) / self.deviation
        x = np.clip(x, -4, 4)
        wl, wv = self.linear[: 1 << WORD_BITS], self.vectors[: 1 << WORD_BITS]
        sl, sv = self.linear[1 << WORD_BITS :], self.vectors[1 << WORD_BITS :]
        total = self.bias + x @ sl + np.bincount(doc, wl[feature] * value, n)
        squares = (sv**2).sum(1)
        half = np.bincount(doc, (wv**2).sum(1)[feature] * value**2, n) + x**2 @ squares
        pairs = -half
        for f in range(RANK):
            pairs += (np.bincount(doc, wv[feature, f] * value, n) + x @ sv[:, f]) ** 2
        return 1 / (1 + np.exp(-np.clip(total + 0.5 * pairs, -30, 30)))


_UPPER, _DIGIT, _ALPHA = (np.array([f(b) for b in range(256)], np.int64) for f in (lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b >= 128 or chr(b).isalpha()))


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word, share) of the distinct words of each text, and the texts' statistics."""
    n = len(offsets) - 1
    starts, ends, first = words(buf, offsets)
    n_words = np.diff(first)
    size = np.diff(offsets).astype(float)
    hashes = word_hashes(buf, starts, ends)
    owner = np.repeat(np.arange(n), n_words)
    keys, count = np.unique((owner << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    doc, feature = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    value = np.sqrt(count / n_words[doc])

    def per_text(of_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_byte)])
        return total[offsets[1:]] - total[offsets[:-1]]

    one, letters = np.maximum(size, 1), np.maximum(per_text(_ALPHA[buf]), 1)
    some = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    last, initial = buf[ends - 1] if len(ends) else buf[:0], buf[starts] if len(starts) else buf[:0]
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(hashes))
    if len(hashes) > 2:
        again[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    mean = np.bincount(owner, length, n) / some
    columns = [
        np.log1p(size), np.log1p(n_words), mean, np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0)),
        per_text(_UPPER[buf]) / letters, per_text(_DIGIT[buf]) / one, per_text(1 - _ALPHA[buf]) / one, per_text((buf >= 128).astype(np.int64)) / one,
        per_text((buf == 10).astype(np.int64)) / some, np.bincount(doc, minlength=n) / some, np.bincount(owner, same, n) / some, np.bincount(owner, again, n) / some,
        np.bincount(owner, 1 - _ALPHA[last], n) / some, np.bincount(owner, _UPPER[initial], n) / some,
        *(per_text((buf == s).astype(np.int64)) / some for s in SIGNS),
    ]
    return doc, feature, value, np.stack(columns, axis=1)


def train(rows: list[tuple[str, int]], seed: int = 3) -> Model:
    """Fit the machine to labelled texts by Adagrad on the logistic loss, in batches of 64."""
    rng = np.random.default_rng(seed)
    width = (1 << WORD_BITS) + STATISTICS
    linear, vectors = np.zeros(width), rng.normal(0, 0.01, (width, RANK))
    label = np.array([y for _, y in rows], float)
    if not len(rows) or label.min() == label.max():
        p = (label.sum() + 1) / (len(rows) + 2)
        return Model(float(np.log(p / (1 - p))), linear, np.zeros((width, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS))
    data, offsets = column_bytes(pa.array([t for t, _ in rows], pa.string()))
    doc, feature, value, statistics = features(data, offsets)
    mean, deviation = statistics.mean(0), statistics.std(0) + 1e-6
    x = np.clip((statistics - mean) / deviation, -4, 4)
    first = np.searchsorted(doc, np.arange(len(rows) + 1))
    at_stat = (1 << WORD_BITS) + np.arange(STATISTICS)
    bias, g_bias = np.log(label.mean() / (1 - label.mean())), 1e-8
    g_linear, g_vectors = np.full(width, 1e-8), np.full((width, RANK), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            index = np.concatenate([np.concatenate([feature[first[d] : first[d + 1]], at_stat]) for d in batch])
            amount = np.concatenate([np.concatenate([value[first[d] : first[d + 1]], x[d]]) for d in batch])
            size = first[batch + 1] - first[batch] + STATISTICS
            row = np.repeat(np.arange(len(batch)), size)
            cuts = np.cumsum(size) - size
            part = vectors[index] * amount[:, None]
            sums = np.add.reduceat(part, cuts, axis=0)
            z = bias + np.add.reduceat(linear[index] * amount, cuts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((part**2).sum(1), cuts))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[batch]) / len(batch)
            used, back = np.unique(index, return_inverse=True)
            by = slope[row] * amount
            d_linear = np.bincount(back, by, len(used)) + DECAY * linear[used]
            each = by[:, None] * (sums[row] - part)
            d_vectors = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * vectors[used]
            g_linear[used] += d_linear**2
            g_vectors[used] += d_vectors**2
            g_bias += slope.sum() ** 2
            linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            vectors[used] -= RATE * d_vectors / np.sqrt(g_vectors[used])
            bias -= RATE * slope.sum() / np.sqrt(g_bias)
    return Model(float(bias), linear, vectors, mean, deviation)


def scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for i, j in slices(offsets):
        out[i:j] = model.score(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most 2 x SAMPLE_ROWS labelled documents; labels of the held-out fold are not used."""
    rows = training_rows(docs, labels, "quality").collect()
    return train(sorted((r["text"], int(r["label"])) for r in rows))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score all documents: doc_id, held_out, score in 0..1, predicted (score >= threshold).

    Only the text is an input of a score. Null and empty texts have no words and the
    statistics of an empty text. Without labels of both kinds all texts score alike.
    Repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0), "score": scores(*column_bytes(batch.column(1)), shared.value)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
