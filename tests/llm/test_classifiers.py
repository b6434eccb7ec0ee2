"""Toxic spans and quality scores: marginals by enumeration, held-out accuracy, edge rows."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from dispatchlens.llm import labelled
from dispatchlens.llm import subword_quality as Q
from dispatchlens.llm import toxic_crf as X

SF = "/root/testdata/sf0.1"


def tables(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    size = np.array([3, 0, 1, 6])
    first = np.cumsum(size) - size
    gain, step = rng.normal(0, 2, 10), rng.normal(0, 1, (2, 2))
    p, pairs = X.marginals(gain, first, size, step, True)
    truth, count = np.zeros(10), np.zeros((2, 2))
    for f, s in zip(first, size, strict=True):
        if not s:
            continue
        ways = list(product((0, 1), repeat=int(s)))
        weight = np.exp([sum(gain[f + k] for k in range(s) if y[k]) + sum(step[y[k - 1], y[k]] for k in range(1, s)) for y in ways])
        weight /= weight.sum()
        for y, w in zip(ways, weight, strict=True):
            for k in range(s):
                truth[f + k] += w * y[k]
                if k:
                    count[y[k - 1], y[k]] += w
    assert np.allclose(p, truth) and np.allclose(pairs, count)


@pytest.fixture(scope="module")
def field(spark):
    return X.fit(*tables(spark))


@pytest.fixture(scope="module")
def embedding(spark):
    return Q.fit(*tables(spark))


def held_out_rows(found, labels, label):
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.array([tuple(r) for r in rows]).T


def test_toxic_held_out_accuracy_and_spans(spark, field):
    docs, labels = tables(spark)
    found = X.tagged(docs, field).cache()
    score, predicted, truth = held_out_rows(X.digest(found), labels, "toxic")
    assert ((0 <= score) & (score <= 1)).all()
    assert predicted[truth == 0].mean() < 0.01
    assert predicted[truth == 1].mean() > 0.85
    rows = found.join(docs.select("doc_id", "text"), "doc_id").where("size(spans) > 0").limit(50).collect()
    for r in rows:
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(r.text) and r.text[s.start:s.end].strip() == r.text[s.start:s.end]


def test_quality_held_out_accuracy(spark, embedding):
    docs, labels = tables(spark)
    score, predicted, truth = held_out_rows(Q.digest(Q.scored(docs, embedding)), labels, "quality")
    assert ((0 <= score) & (score <= 1)).all()
    assert (predicted == truth).mean() > 0.97


def test_edge_rows(spark, field, embedding):
    rows = [(1, None, 1.0), (1, None, 1.0), (2, "", 2.0), (None, "an idiot, a moron", 3.0), (4, "word " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for module, model, read in ((X, field, X.tagged), (Q, embedding, Q.scored)):
        got = module.digest(read(docs, model)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert read(docs.limit(0), model).collect() == []


def test_ngrams_of_whole_words(monkeypatch):
    texts = ["x" * 30, "".join(map(str, range(60))), "\u4e2d\u6587\u5b57" * 40 + " ab", "", "abc " * 30 + "q" * 41]
    data, limits = Q.flat(pa.array(texts))

    def all_of():
        doc, weight = (np.concatenate(p) for p in list(zip(*Q.features(data, limits), strict=True))[1:])
        return np.bincount(doc, weight, len(texts))

    grams = lambda t: sum(max(0, len(w.encode()) - k + 1) for w in t.split() for k in Q.NGRAMS)
    plain = [2 * len(t.split()) + max(0, len(t.split()) - 1) for t in texts]
    same = [sum(4 for a, b in zip(t.split(), t.split()[1:], strict=False) if a == b) for t in texts]
    expected = [grams(t) + p + s for t, p, s in zip(texts, plain, same, strict=True)]
    assert all_of().tolist() == expected
    whole = Q.bag(data, limits)
    monkeypatch.setattr(Q, "BLOCK", 7)
    assert all_of().tolist() == expected
    assert all((a == b).all() for a, b in zip(whole, Q.bag(data, limits), strict=True))


def test_ends_of_long_words_count(spark):
    docs = spark.createDataFrame([(1, "a" * 40 + "bcd" * 20), (2, "a" * 40 + "bce" * 20)], "doc_id long, text string")
    gain = np.zeros(1 << Q.BUCKETS_LOG2)
    at = (Q.mix64(Q.hashes(np.frombuffer(b"bcd", np.uint8), np.array([0]), np.array([3]), Q.BYTE_VALUE) + Q.salt(3))
          >> np.uint64(64 - Q.BUCKETS_LOG2))
    gain[at.astype(np.int64)] = 1.0
    score = {r.doc_id: r.score for r in Q.scored(docs, Q.Embedding(gain, 1.0, 0.0)).collect()}
    assert score[1] > score[2] == 0.5


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.tagged(docs, X.fit(docs, labels)).first().score < 1e-6
    assert Q.scored(docs, Q.fit(docs, labels)).first().score == 0.5


def test_long_chains_do_not_depend_on_slices():
    rng = np.random.default_rng(4)
    gain, step = rng.normal(0, 1, 500), rng.normal(0, 1, (2, 2))
    whole = X.marginals(gain, np.array([0, 400]), np.array([400, 100]), step)
    assert np.allclose(whole[400:], X.marginals(gain[400:], np.array([0]), np.array([100]), step))


def test_length_is_not_toxic(spark, field):
    docs, labels = tables(spark)
    clean = [r.text for r in docs.join(labels, "doc_id").where("toxic = 0 and length(text) > 50").orderBy("doc_id").limit(2000).collect()]
    toxic = [r.text for r in X.tagged(docs.join(labels, "doc_id").where("toxic = 1"), field, ("text",)).where("score > 0.9").limit(20).collect()]
    rng = np.random.default_rng(3)
    rows = [(n, " ".join(clean[k] for k in rng.choice(len(clean), n, replace=False))) for n in (10, 50, 200) for _ in range(20)]
    marked = [(1000 + n, f"{text} {toxic[k % len(toxic)]}") for k, (n, text) in enumerate(rows)]
    frame = spark.createDataFrame(rows + marked, "doc_id long, text string")
    found = np.array([(r.doc_id, r.score) for r in X.tagged(frame, field).collect()])
    for n in (10, 50, 200):
        assert (found[found[:, 0] == n, 1] >= 0.5).mean() <= 0.05, n
        assert (found[found[:, 0] == 1000 + n, 1] >= 0.5).all(), n


def test_training_rows_are_bounded(spark):
    ids = [k for k in range(200)]
    docs = spark.createDataFrame([(k, f"text {k}") for k in ids] + [(1, "text 1")] * 300 + [(1, "other"), (2, None), (2, "")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(1, 1)] * 3, "doc_id long, toxic int")
    texts, y, weight = labelled.training_rows(docs, labels, "toxic", 1000)
    assert len(set(texts.to_pylist())) >= len(texts) - 1 and texts.to_pylist().count("text 1") <= 1
    assert len(labelled.training_rows(docs, labels, "toxic", 40)[0]) <= 40
    few = labelled.training_rows(docs, labels, "toxic", 1000, 100)[0]
    assert 0 < sum(len(t or "") for t in few.to_pylist()) <= 100
    assert len(y) == len(weight) == len(texts)
