"""Labelled training rows for the classifiers: a bounded, reproducible sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS, MAX_BYTES = 3_000, 1 << 27


def fold(doc_id: str = "doc_id") -> Column:
    """The remainder that sets rows apart: those of 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def held_out() -> Column:
    return F.coalesce(fold() == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS,
                  max_bytes: int = MAX_BYTES) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``max_rows`` labelled rows, of ``max_bytes`` together, that are not held out.

    Each class gives the half at most, its rows of least hash; the weights restore
    the classes' shares.  A document with several labels counts as 1 if any is 1, and
    rows of equal id and text count once.  Where the bytes don't suffice, there are
    fewer rows, those of least hash; texts are whole.
    """
    known = labels.where(F.col(label).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for value in sorted(sizes):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0)
    # Hashes first: many copies of one id meet as numbers, and only the chosen texts are read.
    named = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))
    least = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("copy")]
    copies = named.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "copy").agg(
        F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    chosen = copies.orderBy(*least).limit(max_rows).withColumn(
        "up_to", F.sum("size").over(Window.orderBy(*least).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("up_to") <= max_bytes)
    rows = (named.join(F.broadcast(chosen.select("doc_id", "copy", "label")), ["doc_id", "copy"])
            .groupBy("doc_id", "copy", "label").agg(F.max("text").alias("text")).orderBy("doc_id", "copy").toArrow())
    label_of = rows.column("label").to_numpy().astype(np.int64)
    taken = {v: max(1, int((label_of == v).sum())) for v in sizes}
    weight = np.array([sizes[v] / taken[v] for v in label_of.tolist()])
    return rows.column("text").combine_chunks(), label_of, weight / max(weight.mean(), 1e-9) if len(weight) else weight


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w
