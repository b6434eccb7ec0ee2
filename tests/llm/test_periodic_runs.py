"""Periodic runs against a plain search of every period, on random, planted and hostile word sequences."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchlens.llm import periodic_runs as P
from dispatchlens.llm.registry import QUERIES
from dispatchlens.llm.text import mix64

SMALL = "/root/testdata/sf0.001"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    n, seen, out = len(w), {}, []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and (i, length) not in seen:
                seen[i, length] = q
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast_runs(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    word = mix64(np.array([x + 1 for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = [[] for _ in texts]
    for t, s, n, q in zip(*P.find_runs(word, at)):
        out[t].append((int(s), int(n), int(q)))
    return out


def sequences(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    out = [[], [1], [2] * 5, [2] * 6, [2] * 7, [1, 2] * 4, [1, 2] * 4 + [1], list(range(50)) * 4, list(range(50)) * 4 + [0]]
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 40])
        w = []
        while len(w) < rng.randrange(1, 900):
            period = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 7, 11, 12, 13, 14, 19, 20, 21, 32, 33, 50, 51, 77, 120, 178]))]
            whole = period * rng.choice([1, 2, 4, 5])
            w += whole[:len(whole) - rng.choice([0, 0, 1])] + [rng.randrange(letters) for _ in range(rng.randrange(4))]
        out.append(w)
    # A sequence on which sums of powers of an odd base collide.
    out.append([bin(i).count("1") % 2 for i in range(2048)] * 4)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_a_plain_search(seed):
    texts = sequences(seed)
    assert fast_runs(texts) == [plain_runs(w) for w in texts]


def test_every_period_is_found_at_four_repeats():
    texts = [list(range(q)) * 4 for q in range(1, 700)]
    wanted = [[(0, 4 * q, q)] if 4 * q >= 6 else [] for q in range(1, 700)]
    assert fast_runs(texts) == wanted


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_a_plain_search(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).select(*COLUMNS).collect()}
    assert got == {expected(r.doc_id, r.text) for r in docs}


def test_odd_rows(spark):
    hard = ["", None, " \t\n", "a " * 200, "é é é é é é", "x\x0by\x0cx y x y x y\r", "a b " * 3 + "a b", "α β γ " * 40, "😀 " * 6,
            "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 " * 5]
    rows = [(k, t) for k, t in enumerate(hard)] + [(3, "a " * 200), (None, "b b b b b b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"runs": F.lit("clash"), "k_body": F.lit(1), "n_words": F.lit(2)})
    seed = F.crc32(F.col("doc_id").cast("string"))
    got = sorted(map(tuple, P.digest(P.annotated(docs, plant=seed)).select(*COLUMNS).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert P.digest(P.annotated(docs.limit(0))).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 30_011}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = P.annotated(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 150_000, 30_011)]
    assert row.collapsed == " ".join(f"w{i}" for i in range(30_011))
