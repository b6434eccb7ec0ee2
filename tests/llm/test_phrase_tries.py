"""Collocations against plain counting; the trie against a dictionary; odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from dispatchlens.llm import phrase_tries as P
from dispatchlens.llm.text import mix64

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, top=2000):
    f = {}
    for text, lang in rows:
        count = f.setdefault("und" if lang is None else lang, [Counter(), Counter(), Counter()])
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(3):
                count[k].update(tuple(w[i:i + k + 1]) for i in range(len(w) - k))
    out = []
    for lang, count in f.items():
        n, found = sum(count[0].values()), []
        for k in (2, 3):
            for p, a in count[k - 1].items():
                if a < least:
                    continue
                cuts = [(1_000_000 * a * a // (count[c - 1][p[:c]] * count[k - c - 1][p[c:]]), c) for c in range(1, k)]
                value, c = min(cuts)
                longer = [x for q, x in count[2].items() if k == 2 and x >= least and (q[:2] == p or q[1:] == p)]
                if any(100 * x >= 50 * a for x in longer):
                    continue
                found.append((-value, -a, " ".join(p).encode(), count[c - 1][p[:c]], count[k - c - 1][p[c:]]))
        out += [(lang, i + 1, phrase.decode(), -a, l, r, n, -s) for i, (s, a, phrase, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(docs, **more):
    return sorted(map(tuple, P.collocations(docs, **more).select(*COLUMNS).collect()))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["a", "The", "mit", "Ünder", "日本", "x😀", "don't", "-", "q7"] + [f"w{i}" for i in range(25)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary[:rng.choice([3, 9, 34])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "])
                       for _ in range(rng.randrange(0, 120)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "fr"), ("alone", "fr")] + rows[:10]


@pytest.mark.parametrize("seed,block,top", [(1, 400_000, 2000), (2, 12, 2000), (3, 400_000, 7)])
def test_phrases_are_those_of_plain_counting(spark, monkeypatch, seed, block, top):
    monkeypatch.setattr(P, "BLOCK", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "text string, lang string, k1 int, word string")
    wanted = plain(rows, top=top)
    assert wanted and got(docs.repartition(3), top=top) == wanted


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert got(empty) == []
    assert got(spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")) == []
    long = [("b a " * 60_000 + "c", "en")]
    assert got(spark.createDataFrame(long, "text string, lang string")) == plain(long)


def test_scores_of_large_counts_are_exact(spark):
    big = 9_000_000_000_000
    df = spark.createDataFrame([(big - 1, big, big), (big, big, big), (3, 7, 11), (big // 3, big, big - 2)], "a long, l long, r long")
    found = df.select("a", "l", "r", P.score(df.a, df.l, df.r).alias("s")).collect()
    assert [r.s for r in found] == [1_000_000 * r.a * r.a // (r.l * r.r) for r in found]


@pytest.mark.parametrize("size", [1, 3, 300, 70_000])
def test_trie_counts_what_a_dictionary_counts(size):
    rng = np.random.default_rng(size)
    key = np.sort(mix64(np.arange(1, size + 1, dtype=np.uint64)))
    text = key[np.minimum((rng.random(60_000) ** 3 * size).astype(int), size - 1)]
    n = 4_000
    at = rng.integers(0, len(text) - 3, n)
    phrases, length = np.stack([text[at], text[at + 1], text[at + 2]], axis=1), rng.integers(2, 4, n)
    phrases[length == 2, 2] = 0
    phrases, first = np.unique(phrases, axis=0, return_index=True)
    length = length[first]
    following = rng.random(len(text)) < 0.9
    following[-1] = False
    count = Counter()
    for i in range(len(text) - 1):
        if following[i]:
            count[text[i], text[i + 1], 0] += 1
            if following[i + 1]:
                count[text[i], text[i + 1], text[i + 2]] += 1
    trie = P.Trie(phrases, length)
    assert trie.counted(text, following, np.flatnonzero(following), 3, len(phrases)).tolist() == [count[tuple(p)] for p in phrases]
    assert len(trie.base) < 4 * len(phrases) * 3 * trie.digits + 1024
