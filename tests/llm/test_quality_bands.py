"""Quality rules against a plain count, and verdicts on labelled documents."""

import random
import re
from collections import Counter

from dispatchlens.llm import quality_bands as B

from ..conftest import SF_CHECK

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    inside = {k + j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def fixture():
    rng = random.Random(1)
    words = [chr(97 + k) * (1 + k % 5) for k in range(26)] + ["é", "　x", "a\x1cb", "\x85"]
    rows = [None, "", " \t\n", "one", "a b c d e f g h " * 3, "same line\nsame line\n\n same line\nsame line", "#*$%&|<>[]" * 5]
    rows += [" ".join(rng.choices(words, k=n)) for n in (7, 8, 9, 30, 400)]
    rows += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     \n", k=9000)), "x" * 50_000, "word " * 20_000]
    return rows


def test_measures_match_a_plain_count(spark):
    rows = list(enumerate(fixture()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in B.judged(docs).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert not (r.base_failed and r.kept)


def test_documents_and_verdicts(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = {r.doc_id: r for r in B.judged(docs).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(d.text)
    good = spark.read.parquet(f"{SF_CHECK}/labels.parquet").where("quality = 1").collect()
    clean = [got[r.doc_id] for r in good if not got[r.doc_id].base_failed]
    assert all(r.kept for r in clean)
    assert B.passing(docs).count() == sum(r.kept for r in got.values())


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n_words int, kept string")
    assert B.passing(docs.limit(0)).collect() == [] and B.judged(docs.limit(0)).collect() == []
    assert B.passing(docs).columns == docs.columns
    assert B.judged(docs).first().n_words == 2
