"""Near-duplicate classes against all pairs, and signatures against weighted Jaccard."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from dispatchlens.llm import bag_minhash as B

from ..conftest import SF_SMALL

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall((text or "").encode().lower())
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """doc_id -> least doc_id of its class."""
    head = {i: i for i, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for (i, s), (j, t) in combinations(rows, 2):
        a, b = bag(s), bag(t)
        if (similarity(a, b) >= 0.8 if a and b else not a and not b and (s or "") == (t or "")):
            a, b = sorted((find(i), find(j)))
            head[b] = a
    return {i: find(i) for i in head}


def fixture():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    rows, base = [], prose(300)
    for i in range(40):  # copies with a few words changed
        words = list(base)
        for k in rng.integers(0, 300, int(rng.integers(0, 6))):
            words[k] = "changed"
        rows.append((i, " ".join(words)))
    for i in range(40, 60):  # half shared: not near copies
        rows.append((i, " ".join(base[:150] + prose(150))))
    rows += [(60 + i, "the same line again " * (20 + i)) for i in range(10)]
    rows += [(80, None), (81, ""), (82, "!!"), (83, "!!"), (84, "one two"), (85, "One, two."), (86, "one two three four five"),
             (87, "one two three four five six"), (88, " ".join(prose(3000)))]
    return rows


def test_classes_match_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in B.report(docs).collect()} == brute(rows)


def test_classes_match_all_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in B.report(docs).collect()} == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 9, 200)
    agree = []
    for k in range(40):
        shingle = B.mix64(np.arange(200, dtype=np.uint64) + np.uint64(1000 * k))
        owner = np.repeat([0, 1], 200)
        count = np.concatenate([a, b])
        there = count > 0
        times = B.signatures(2, owner[there], np.tile(shingle, 2)[there], count[there])
        assert np.isfinite(times).all()
        agree.append((times[0] == times[1]).mean())
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(agree) - truth) < 4 * np.sqrt(truth * (1 - truth) / (40 * B.SIZE))


def test_signatures_do_not_depend_on_other_rows():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    some = [(draw(n), rng.integers(1, 1 + most, n)) for n in (1, 3, 10, 30, 60, 200) for most in (1, 9) for _ in range(8)]
    others = [(draw(n), rng.integers(1, 1 + most, n)) for n, most in ((20_000, 1), (4_000, 50), (1, 5_000), (2, 1))]

    def sign(rows):
        owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
        return B.signatures(len(rows), owner, *(np.concatenate(x) for x in zip(*rows, strict=True)))

    together = sign(others + some)[len(others):]
    assert (together == sign(some)).all()
    for row, times in zip(some, together, strict=True):
        assert (sign([row])[0] == times).all()


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x", 0), (1, "a b c d e f", "x", 0), (2, "A b c d e f!", "y", 1), (3, None, None, None),
            (None, "other words here now ok", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_id string, node int")
    kept = B.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for k, r in enumerate(docs.collect()) if k in (0, 3, 4)]))
    assert B.report(docs.limit(0)).collect() == []


def test_bags_count_shingles():
    _, owner, _, count = B.bags(pa.array(["a b c d e a b c d e", None, "x"]))
    assert (owner.tolist(), sorted(count.tolist())) == ([0, 0, 0, 0, 0, 2], [1, 1, 1, 1, 1, 2])
