"""Text quality by supervised subword embeddings.

Every word of a text, its case and symbols kept, and its character n-grams, all of
them however long the word, have learned vectors, found by hashing; so have pairs of
neighbouring words, the shapes of words and of lines, and marks for words and lines
that came before.  The mean of all vectors is the text's vector, and a softmax over it
the class.  Vectors and softmax are trained together by stochastic gradient descent in
numpy.

Scoring needs only the product of the vectors and the softmax weights, one number a
feature, so a text costs one look-up a feature; sums of a word's n-grams are kept per
distinct word of a slice.

Labels are read only from rows that are not held out, ``max_rows`` at most.

Defined results: null and empty texts have no features and get the score of the
bias; without labels all scores are 0.5; rows are judged one by one, so repeated
rows, ties and empty tables need no rule; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_ROWS, held_out, logistic, training_rows
from .tables import per_row
from .text import BASE, BYTE_VALUE, SOLID, flat, hashes, mix64, powers, salt, within, words

BUCKETS_LOG2, DIMENSIONS = 18, 16
NGRAMS = (3, 4, 5)
EPOCHS, RATE, BATCH = 5, 0.5, 32
PREDICTED = 0.3
#: Character n-grams built at once.
BLOCK = 1 << 20


@dataclass
class Embedding:
    """One number for each bucket: its vector times the difference of the softmax weights; scale and bias of the score."""

    gain: np.ndarray
    scale: float
    bias: float


#: Classes of bytes that make a word's shape: lower, upper, digit, symbol, other.
SHAPE = np.zeros(256, np.uint8) + 3
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 0, 1, 2, 0
SHAPE_VALUE = mix64(SHAPE.astype(np.uint64) + np.uint64(77))


def features(data: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, document and weight of every feature occurrence, in blocks; equal ones may come several times."""
    for found, doc, weight in hashed(data, limits):
        yield (found >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), doc, weight


def hashed(data: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    starts, ends, at = words(data, limits, SOLID)
    n = len(starts)
    doc = np.repeat(np.arange(len(limits) - 1), np.diff(at))
    if not n:
        return
    h = hashes(data, starts, ends, BYTE_VALUE)
    yield h, doc, np.ones(n)
    # Character n-grams once for each distinct word, weighted by its number in each document.
    order = np.lexsort((h, doc))
    new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]))
    one, times = order[new], np.diff(np.append(new, n)).astype(np.float64)
    start, size = starts[one], ends[one] - starts[one]
    for k in NGRAMS:
        room = np.maximum(0, size - k + 1)
        upto = np.cumsum(room)
        for a in range(0, int(upto[-1]), BLOCK):
            b = min(a + BLOCK, int(upto[-1]))
            near = np.arange(np.searchsorted(upto, a, "right"), np.searchsorted(upto, b, "left") + 1)
            word = np.repeat(near, np.minimum(upto[near], b) - np.maximum(upto[near] - room[near], a))
            begin = start[word] + np.arange(a, b) - (upto - room)[word]
            total = np.zeros(b - a, np.uint64)
            for j, power in enumerate(powers(BASE, k)):
                total += BYTE_VALUE[data[begin + j]] * power
            yield mix64(mix64(total) + salt(k)), doc[one][word], times[word]
    # Shapes of word ends, where symbols and cases show.
    yield mix64(hashes(data, np.maximum(starts, ends - 3), ends, SHAPE_VALUE) + salt(11)), doc, np.ones(n)
    if n > 1:
        pair = within(at, 2, n)
        yield mix64(h[:-1] * np.uint64(31) + h[1:])[pair], doc[:-1][pair], np.ones(int(pair.sum()))
        same = pair & (h[1:] == h[:-1])
        yield np.full(int(same.sum()), salt(12)), doc[1:][same], np.full(int(same.sum()), 4.0)
    # A mark for each word of a line that came before in the document.
    b0, b1, line_at = words(data, limits, LINE)
    if len(b0):
        line = hashes(data, b0, b1, BYTE_VALUE)
        line_doc = np.repeat(np.arange(len(limits) - 1), np.diff(line_at))
        order = np.lexsort((np.arange(len(line)), line, line_doc))
        again = np.zeros(len(line), bool)
        again[order[1:]] = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        held = (np.searchsorted(starts, b1) - np.searchsorted(starts, b0))[again]
        yield np.full(int(again.sum()), salt(13)), line_doc[again], 4.0 * held


LINE = np.ones(256, bool)
LINE[10] = False


def bag(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) and their shares of the document's features."""
    key, total = np.zeros(0, np.int64), np.zeros(0)
    for bucket, doc, weight in features(data, limits):  # weights are whole, so their sums are exact
        key, inverse = np.unique(np.concatenate([key, (doc << BUCKETS_LOG2) + bucket]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([total, weight]), len(key))
    doc = key >> BUCKETS_LOG2
    return doc, key & ((1 << BUCKETS_LOG2) - 1), total / np.bincount(doc, total)[doc] if len(doc) else total


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Embedding:
    texts, y, weight = training_rows(docs, labels, label, max_rows)
    if not (y == 1).any() or not (y == 0).any():
        return Embedding(np.zeros(1 << BUCKETS_LOG2), 1.0, 0.0)
    data, limits = flat(texts)
    parts = []
    step = 200
    for a in range(0, len(y), step):
        cut = limits[a:a + step + 1]
        d, b, s = bag(data[cut[0]:cut[-1]], cut - cut[0])
        parts.append((d + a, b, s))
    doc, bucket, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    rng = np.random.default_rng(0)
    vector = rng.uniform(-1, 1, (1 << BUCKETS_LOG2, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax, bias = rng.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    balance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            of = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            hidden = np.zeros((len(rows), DIMENSIONS), np.float32)
            if len(at):
                some = np.flatnonzero(first[rows + 1] > first[rows])
                heads = np.searchsorted(of, some)
                hidden[some] = np.add.reduceat(vector[bucket[at]] * share[at, None].astype(np.float32), heads)
            z = hidden @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            error = p * balance[rows, None]
            back = error @ softmax.T
            softmax -= rate / len(rows) * 4 * hidden.T @ error
            bias -= rate / len(rows) * error.sum(axis=0)
            np.subtract.at(vector, bucket[at], rate * back[of] * share[at, None].astype(np.float32) * 20)
    gain = (vector @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64)
    x = np.bincount(doc, gain[bucket] * share, len(y))
    scale, shift = logistic(x[:, None], y.astype(np.float64), weight)
    return Embedding(gain, float(scale), float(shift))


def scored(docs: DataFrame, model: Embedding, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, the probability of the class 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list:
        m = sent.value
        total, x = np.zeros(part.num_rows), np.zeros(part.num_rows)
        for bucket, doc, weight in features(*flat(part.column(text))):
            np.add.at(total, doc, weight)
            np.add.at(x, doc, m.gain[bucket] * weight)  # one by one: the sum does not depend on where blocks end
        x /= np.maximum(total, 1e-12)
        return [pa.array(1 / (1 + np.exp(-np.clip(m.scale * x + m.bias, -30, 30))))]

    return per_row(docs, text, list(keep), "score double", work, 1 << 20)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= PREDICTED).cast("int").alias("predicted"))
