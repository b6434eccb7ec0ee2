"""Benchmark matches against a plain search, in one block and in many."""

import re

import pytest

from dispatchlens.llm import decontaminate as D

from ..conftest import SF_SMALL

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall((text or "").encode().lower()) if text is None or text.isascii() else \
        WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, names = tokens(text), set(), set()
        for name, item in items:
            t = tokens(item)
            m = min(10, len(t))
            windows = {tuple(t[k:k + m]) for k in range(len(t) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k:k + m]) in windows:
                    hit.update(range(k, k + m))
                    names.add("null" if name is None else str(name))
        out.append((i, len(w), len(hit), ",".join(sorted(names)), bool(hit)))
    return sorted(out, key=str)


def fixture():
    a = " ".join(f"w{k}" for k in range(25))
    items = [(1, a), (10, "short one"), (2, None), (3, "!!"), (None, "É lone ü"), (4, "aa " * 14), (5, a), (7, "solo")]
    docs = [(1, a), (2, "x " + a.upper().replace(" ", ", ")), (3, " ".join(f"w{k}" for k in range(9))), (4, "a short one, Short One"),
            (5, None), (6, ""), (7, "é lone ü; É lone ü"), (8, "aa " * 30), (9, "w3 " + " ".join(f"w{k}" for k in range(3, 14))),
            (1, a), (None, "so solo lo"), (11, "word " * 50_000 + a)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_matches_a_plain_search(spark, block_bytes):
    rows, items = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.matches(docs, bench, block_bytes=block_bytes).collect()
    got = []
    for r in found:
        hit = {k for m in r.matches for k in range(m.start, m.start + m.words)}
        got.append((r.doc_id, r.n_words, len(hit), ",".join(sorted({m.item for m in r.matches})), bool(hit)))
    assert sorted(got, key=str) == brute(rows, items)
    short = {(r.doc_id, r.n_hit, r.n_items) for r in D.digest(D.matches(docs, bench, block_bytes=block_bytes)).collect()}
    assert short == {(i, n, len(names.split(",")) if names else 0) for i, _, n, names, _ in brute(rows, items)}
    longest = {r.doc_id: r.longest_match for r in D.digest(D.matches(docs, bench)).collect()}
    assert (longest[1], longest[9], longest[5]) == (25, 11, 0)


def test_clean_keeps_the_rest(spark):
    docs, bench = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    bad = {r[0] for r in brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()]) if r[4]}
    kept = D.clean(docs.withColumn("matches", docs.lang), bench)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad and bad
    assert D.clean(docs, bench.limit(0)).count() == docs.count()
    assert D.matches(docs.limit(0), bench).collect() == []
