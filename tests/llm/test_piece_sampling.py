"""Sampled segmentations: lossless, reproducible, and distributed like an enumeration."""

from collections import Counter

import numpy as np
import pytest

from dispatchlens.llm import piece_sampling as P

from ..conftest import SF_SMALL

TEXTS = ["", "Hello  world\nab▁c \tx", " a", "   ", "naïve 中文 \U0001f600\x00 end \r\n\n", "x" * 3000, "a" * 5 + " " * 40 + "b", "▁"]


@pytest.fixture(scope="module")
def pieces():
    return P.pieces_of()


def split(ids, count):
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_round_trip_and_keys(pieces):
    keys = np.arange(len(TEXTS))
    one = split(*P.encode_texts(TEXTS, keys, P.Solved(pieces), 1))
    assert [P.decode_ids(x, pieces) if x else "" for x in one] == TEXTS
    back = split(*P.encode_texts(TEXTS[::-1], keys[::-1], P.Solved(pieces), 1))[::-1]
    assert back == one
    assert split(*P.encode_texts(TEXTS, keys, P.Solved(pieces), 2)) != one


def test_draws_follow_the_enumerated_weights(pieces):
    word = " there"
    known = {t: i for i, t in enumerate(pieces.text) if t and i not in set(pieces.byte)}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            i = known.get(rest[:k])
            if i is not None:
                for tail, w in ways(rest[k:]):
                    yield (i, *tail), w + pieces.weight[i]

    weights = {ids: np.exp(w) for ids, w in ways(word.encode())}
    n = 40_000
    rows = split(*P.encode_texts([word[1:]] * n, np.arange(n), P.Solved(pieces), 7))
    seen = Counter(map(tuple, rows))
    assert set(seen) <= set(weights)
    total = sum(weights.values())
    for ids, w in weights.items():
        p = w / total
        assert abs(seen[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_documents_decode_to_themselves_under_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in P.decode(P.encode(docs)).collect()}
    for r in docs.collect():
        assert rows[r.doc_id].decoded == r.text
    again = {r.doc_id: r.pieces for r in P.encode(docs.repartition(5)).collect()}
    assert again == {i: r.pieces for i, r in rows.items()}


def test_kept_lattices_decide_nothing(pieces):
    texts = [f"{a} {b} there naïve" for a in TEXTS for b in TEXTS]
    keys = np.arange(len(texts))
    alone = [P.encode_texts([t], keys[k:k + 1], P.Solved(pieces), 3)[0].tolist() for k, t in enumerate(texts)]
    for kept in (1 << 20, 50):
        store = P.Solved(pieces, kept)
        parts = [split(*P.encode_texts(texts[k:k + 5], keys[k:k + 5], store, 3)) for k in range(0, len(texts), 5)]
        assert [x for part in parts for x in part] == alone


def test_a_very_long_unit(pieces):
    text = "ab1" * 80_000
    ids, count = P.encode_texts([text], np.array([5]), P.Solved(pieces), 1)
    assert count[0] == len(ids) and P.decode_ids(ids.tolist(), pieces) == text


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "a b", 4), (2, "", 5), (2, "", 5)], "doc_id long, text string, pieces int")
    got = P.decode(P.encode(docs)).collect()
    assert sorted((str(r.doc_id), r.decoded, len(r.pieces) > 0) for r in got) == [
        ("1", "", False), ("2", "", False), ("2", "", False), ("None", "a b", True)]
    assert P.decode(P.encode(docs.limit(0))).collect() == []
