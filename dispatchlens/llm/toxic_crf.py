"""Toxic spans by a linear-chain conditional random field.

A token is toxic or not; its label depends on its own features (hashes of the word,
of its beginnings and of its end) and on its neighbours' labels.  Documents are
labelled, not tokens, so token labels come first: the fewest words and beginnings of
words that explain the toxic training documents and are rare in the others, found by
greedy cover, mark toxic tokens in toxic documents.  The field learns from these labelled tokens by gradient ascent on their
likelihood; the gradient is what forward-backward marginals lack from the labels.
Scoring runs forward-backward over all tokens of a text; the marginals give the
offending spans and, summed up by the largest and by the most likely toxic tokens that
stand near each other, the score: stray ones don't add up over a long text, and a toxic
passage counts as much in a long text as in a short one.

Labels are read only from rows that are not held out, ``max_rows`` at most.

Defined results: null and empty texts have no tokens and get the score of no toxic
token; without any toxic training row all scores are 0; rows are judged one by one,
so repeated rows, ties and empty tables need no rule; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_ROWS, held_out, logistic, training_rows
from .tables import per_row
from .text import flat, hashes, mix64, salt, words

BUCKETS_LOG2 = 18
WINDOW, EPOCHS, RATE, RIDGE = 128, 6, 0.5, 1e-6
SUFFIX, BEGINNINGS = 3, (4, 5, 6, 7, 8)
#: A token is called toxic from this marginal on; tokens are near each other within so many.
LIKELY, NEAR = 0.5, 128
#: A mark of toxic tokens: how many times chance it stands in toxic documents, and what it explains anew at least.
RARE, LEAST_ROWS, LEAST_SHARE = 4.0, 3, 0.02
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


@dataclass
class Field:
    """Gains of the toxic label over the other: by feature, by bias, and by the label before; and the score's weights."""

    emission: np.ndarray
    bias: float
    step: np.ndarray  # 2 x 2: label before, label
    score: np.ndarray

def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's word and of its beginnings (0: the word is no longer), and its buckets.

    The last bucket stands for a beginning that is not there; its gain stays 0.
    """
    kinds = [hashes(data, starts, ends)]
    for k in BEGINNINGS:
        begin = mix64(hashes(data, starts, np.minimum(ends, starts + k)) + salt(k))
        kinds.append(np.where(ends - starts > k, begin, np.uint64(0)))
    tail = mix64(hashes(data, np.maximum(starts, ends - SUFFIX), ends) + np.uint64(1))
    kinds = np.column_stack(kinds)
    shift = np.uint64(64 - BUCKETS_LOG2)
    bucket = np.column_stack([kinds >> shift, tail >> shift]).astype(np.int32)
    bucket[:, :-1][kinds == 0] = 1 << BUCKETS_LOG2
    return kinds, bucket


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(gain: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray, pairs: bool = False):
    """Probability of the toxic label of each token, of chains that begin at ``first`` and have ``size`` tokens.

    All chains advance together, longest first.  With ``pairs`` also the expected
    counts of neighbouring labels.
    """
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    n = len(gain)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # chains of more than t tokens
    for t in range(longest):
        at = first[:alive[t]] + t
        if t:
            before = alpha[at - 1]
            alpha[at, 0] = log_sum(before[:, 0] + step[0, 0], before[:, 1] + step[1, 0])
            alpha[at, 1] = log_sum(before[:, 0] + step[0, 1], before[:, 1] + step[1, 1])
        alpha[at, 1] += gain[at]
    for t in range(longest - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        after0, after1 = beta[at + 1, 0], beta[at + 1, 1] + gain[at + 1]
        beta[at, 0] = log_sum(step[0, 0] + after0, step[0, 1] + after1)
        beta[at, 1] = log_sum(step[1, 0] + after0, step[1, 1] + after1)
    both = alpha + beta
    p = np.exp(both[:, 1] - log_sum(both[:, 0], both[:, 1]))
    if not pairs:
        return p
    inner = np.ones(n, bool)
    inner[first[size > 0]] = False
    at = np.flatnonzero(inner)
    total = log_sum(both[at, 0], both[at, 1])
    count = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            count[i, j] = np.exp(alpha[at - 1, i] + step[i, j] + (gain[at] if j else 0) + beta[at, j] - total).sum()
    return p, count


def toxic_kinds(kinds: np.ndarray, doc: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hashes of the words and beginnings that explain the toxic documents: greedy cover, rare elsewhere."""
    which, docs = [], []
    for column in kinds.T:  # each document once for each word or beginning
        there = np.flatnonzero(column)
        order = there[np.lexsort((column[there], doc[there]))]
        k, d = column[order], doc[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])[:len(k)]
        which.append(k[new])
        docs.append(d[new])
    names, which = np.unique(np.concatenate(which), return_inverse=True)
    d = np.concatenate(docs)
    bad = toxic[d] == 1
    in_clean = np.bincount(which[~bad], weight[d[~bad]], len(names))
    in_toxic = np.bincount(which[bad], weight[d[bad]], len(names))
    # The number of toxic documents that would hold it if they were like the others.
    chance = np.maximum(in_clean, 0.25 * weight.min()) / max(1e-9, weight[toxic == 0].sum()) * weight[toxic == 1].sum()
    keep = bad & (in_toxic > RARE * chance)[which]
    which, d = which[keep], d[keep]
    found: list[int] = []
    while len(which):
        gain = np.bincount(which, weight[d], len(names)) - 2 * chance
        best = int(np.argmax(gain))
        if gain[best] <= max((LEAST_ROWS - 0.5) * weight[toxic == 1].min(), LEAST_SHARE * weight[toxic == 1].sum()) and found:
            break
        found.append(best)
        left = ~np.isin(d, d[which == best])
        which, d = which[left], d[left]
    if found:  # one as frequent and as telling as these marks toxic tokens too, though they explain its documents
        telling = in_toxic / chance
        often = in_toxic >= np.median(in_toxic[found]) / 2
        found += np.flatnonzero(often & (telling >= np.median(telling[found]) / 2)).tolist()
    return names[np.unique(np.array(found, np.int64))]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Field:
    return fit_rows(*training_rows(docs, labels, "toxic", max_rows))


def fit_rows(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Field:
    field = Field(np.zeros((1 << BUCKETS_LOG2) + 1), -4.0, np.zeros((2, 2)), np.array([0.0, 0.0, -20.0]))
    if not (toxic == 1).any() or not (toxic == 0).any():
        return field
    data, limits = flat(texts)
    starts, ends, at = words(data, limits)
    kinds, bucket = features(data, starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    marks = toxic_kinds(kinds, doc, toxic, weight)
    y = (np.isin(kinds, marks).any(axis=1) & (toxic[doc] == 1)).astype(np.float64)
    del kinds
    # Chains of WINDOW tokens; every token of every training text is in one.
    first = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(at[:-1], at[1:], strict=True)]).astype(np.int64)
    size = np.minimum(WINDOW, at[1:][doc[first]] - first)
    rng = np.random.default_rng(0)
    squares, step_squares, bias_square = np.full(len(field.emission), 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(EPOCHS):
        for chains in np.array_split(rng.permutation(len(first)), max(1, len(first) // 1024)):
            token = np.concatenate([np.arange(f, f + s) for f, s in zip(first[chains], size[chains], strict=True)])
            local = np.cumsum(size[chains]) - size[chains]
            gain = field.emission[bucket[token]].sum(axis=1) + field.bias
            p, pairs = marginals(gain, local, size[chains], field.step, True)
            error = y[token] - p
            slope = np.bincount(bucket[token].ravel(), np.repeat(error, bucket.shape[1]), len(field.emission))
            slope[-1] = 0
            touched = np.flatnonzero(slope)
            squares[touched] += slope[touched] ** 2
            field.emission[touched] += RATE * slope[touched] / np.sqrt(squares[touched]) - RIDGE * field.emission[touched]
            inner = np.ones(len(token), bool)
            inner[local] = False
            k = np.flatnonzero(inner)
            seen = np.bincount((2 * y[token][k - 1] + y[token][k]).astype(np.int64), minlength=4).reshape(2, 2)
            step_squares += (seen - pairs) ** 2
            field.step += RATE * (seen - pairs) / np.sqrt(step_squares)
            bias_square += error.sum() ** 2
            field.bias += RATE * error.sum() / np.sqrt(bias_square)
    summary = summaries(marginals(field.emission[bucket].sum(axis=1) + field.bias, at[:-1], np.diff(at), field.step), at)
    field.score = logistic(summary, toxic.astype(np.float64), weight)
    return field


def summaries(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logit of the largest marginal, and logarithm of the most likely toxic tokens within NEAR tokens, of each document."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    top, near = np.full(len(size), 1e-6), np.zeros(len(size))
    if len(some):
        top[some] = np.maximum.reduceat(p, at[:-1][some])
    hot = np.flatnonzero(p >= LIKELY)
    row = np.searchsorted(at, hot, "right") - 1
    np.maximum.at(near, row, np.searchsorted(hot, np.minimum(hot + NEAR, at[row + 1])) - np.arange(len(hot)))
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.column_stack([np.log(top / (1 - top)), np.log1p(near)])


def tagged(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``score``, and the offending ``spans`` in code points with their largest marginal."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def work(part: pa.RecordBatch) -> list:
        f = sent.value
        data, limits = flat(part.column(text))
        starts, ends, at = words(data, limits)
        _, bucket = features(data, starts, ends)
        p = marginals(f.emission[bucket].sum(axis=1) + f.bias, at[:-1], np.diff(at), f.step)
        x = summaries(p, at) @ f.score[:-1] + f.score[-1]
        score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        hot = np.flatnonzero(p >= LIKELY)
        spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
        if len(hot):
            codes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            row = np.searchsorted(at, hot, "right") - 1
            zero = codes[limits[row]]
            before = -2
            for k, r, a, b, v in zip(hot.tolist(), row.tolist(), (codes[starts[hot]] - zero).tolist(),
                                     (codes[ends[hot]] - zero).tolist(), p[hot].tolist(), strict=True):
                if k == before + 1 and spans[r]:
                    spans[r][-1] = {"start": spans[r][-1]["start"], "end": b, "probability": max(v, spans[r][-1]["probability"])}
                else:
                    spans[r].append({"start": a, "end": b, "probability": v})
                before = k
        return [pa.array(score), pa.array(spans, SPANS)]

    return per_row(docs, text, list(keep), "score double, spans array<struct<start: long, end: long, probability: double>>", work)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("spans").cast("long").alias("n_spans"))
