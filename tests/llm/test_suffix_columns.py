"""Repeated byte strings against a brute-force count of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchlens.llm import suffix_columns as S

from ..conftest import SF_SMALL


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k + 1:k + length + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(docs, length, max_strings):
    got = S.digest(docs, S.repeats(docs, length=length, max_strings=max_strings))
    return sorted((tuple(r) for r in got.collect()), key=str)


def fixture():
    rng = np.random.default_rng(5)
    prose = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    common, shared = prose(700), prose(260)
    rows = [(i, prose(int(rng.integers(50, 900))) + shared[: int(rng.integers(190, 260))] + prose(40)) for i in range(60)]
    rows += [(100 + i, common[:300] + prose(3) + common[303:]) for i in range(25)]
    rows += [(200, "ab" * 400), (201, "ab" * 300), (202, "a" * 199), (203, "a" * 200), (204, "a" * 201), (205, None),
             (206, ""), (207, common), (207, common), (207, "x" + common), (None, common), (None, prose(500)), (208, shared)]
    return rows


@pytest.mark.parametrize("max_strings", [4096, 5])
def test_matches_brute_force_on_edges(spark, max_strings):
    docs = spark.createDataFrame(fixture(), "doc_id long, text string").repartition(3)
    assert ours(docs, 200, max_strings) == brute(fixture(), 200)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ours(docs, 200, 4096) == brute(rows, 200)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans string, k_id int")
    assert ours(docs, 200, 4096) == []
    rows = [(1, "y" * 300, "s", 1), (2, "clean " * 3, None, None), (3, None, "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, k_id int")
    kept = S.without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "clean " * 3, None, None), (3, None, "t", 3)]
