"""The n-gram join against all pairs, with small chunks and buckets so that every way is taken."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from dispatchlens.llm import shingle_trees as S
from dispatchlens.llm.registry import QUERIES
from dispatchlens.llm.text import mix64

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs of different sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset([tuple(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [tuple(w)] if w else []))
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    by = defaultdict(set)
    for s in parent:
        for t in s:
            by[t].add(s)
    for s in parent:
        for o in {o for t in s for o in by[t]} if len(s) > 5 else ():
            if 100 * len(s & o) >= 85 * len(s | o):
                parent[root(s)] = root(o)
    least = {}
    for (k, _), s in zip(rows, sets):
        if k is not None:
            least[root(s)] = min(k, least.get(root(s), k))
    return sorted([(k, len(s), k if not s else least.get(root(s))) for (k, _), s in zip(rows, sets)], key=str)


def got(docs):
    return sorted([tuple(r) for r in S.linked(docs).select("doc_id", "n_shingles", "component_id").collect()], key=str)


def corpus(seed, groups=12):
    """Groups of copies with a few words changed, growing apart; boilerplate lines; unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.random() ** 3 * 300)}"
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 9, 10, 25, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
            if rng.random() < 0.3:
                base = copy  # drift: ends of a chain of links that are not linked themselves
            texts.append(" ".join(copy) + (" " + line if rng.random() < 0.2 else ""))
    texts += ["", None, " \t", "one", "ONE", "one two three", "x\x0by", "é é é é é", line, line.upper()]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[5]), (None, texts[0]), (None, "only here and with no id at all today")]


@pytest.mark.parametrize("seed,chunk,small", [(1, 1 << 20, 32), (2, 300, 2), (3, 60, 4), (4, 1 << 20, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, chunk, small):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "SMALL", small)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, node int, k_body string")
    assert got(docs) == plain(rows)


def test_query_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_ngram_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_odd_tables(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [("b", "a b c d e f g h"), ("a", "A b c d e f g h"), ("c", None)]
    assert got(spark.createDataFrame(rows, "doc_id string, text string")) == [("a", 5, "a"), ("b", 5, "a"), ("c", 0, "c")]
    long = " ".join(f"v{i % 40_000}" for i in range(60_000))
    rows = [(1, long), (2, long + " and more"), (3, long[:len(long) // 3])]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("step", [40, 1 << 21])
def test_tree_finds_the_links_of_all_pairs(monkeypatch, step):
    monkeypatch.setattr(S, "STEP", step)
    rng = np.random.default_rng(step)
    sets = []
    for _ in range(12):
        base = rng.choice(4000, int(rng.integers(6, 150)), replace=False)
        for _ in range(10):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([keep, rng.choice(4000, int(rng.integers(0, 4)))])))
    sets = [np.array(x) for x in {tuple(s) for s in sets}]
    size = np.array([len(s) for s in sets])
    token, at = mix64(np.concatenate(sets).astype(np.uint64)), np.concatenate([[0], np.cumsum(size)])
    group, label = rng.integers(0, 3, len(sets)), rng.integers(0, 40, len(sets))
    order = np.argsort(group, kind="stable")
    assert len(order)
    tree = S.Tree(group, label, token, at)
    found = set(zip(*(x.tolist() for x in tree.links(group, label, token, at))))
    wanted = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if group[i] == group[j] and label[i] != label[j]
              and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert wanted and found == wanted


def near_copies(seed, n, size, lost):
    """n sets of one base, each without ``lost`` of its shingles and with as many of its own."""
    rng = np.random.default_rng(seed)
    base = mix64(rng.choice(1 << 40, size, replace=False).astype(np.uint64))
    return [np.concatenate([base[np.sort(rng.permutation(size)[lost:])], mix64(rng.choice(1 << 40, lost).astype(np.uint64))]) for _ in range(n)]


def test_copies_that_differ_too_much_are_told_apart_without_reading_them(monkeypatch):
    sets = near_copies(1, 60, 400, 60) + near_copies(2, 4, 400, 5)
    token, at = np.concatenate(sets), np.arange(len(sets) + 1) * 400
    group, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    read = []
    monkeypatch.setattr(S, "mix64", lambda x: (read.append(x.size), mix64(x))[1])
    found = set(zip(*(x.tolist() for x in S.Tree(group, label, token, at).links(group, label, token, at))))
    assert found == {(i, j) for i in range(60, 64) for j in range(60, 64) if i != j}
    assert sum(read) < 12 * token.size  # of 60 * 59 pairs; 40 times before there were parities


def test_parities_never_say_more_than_sets_differ_in():
    rng = np.random.default_rng(3)
    sets = [np.unique(x) for size in (1, 7, 30, 31, 33, 300, 350, 5000) for lost in (0, 1, size // 20) for x in near_copies(size, 3, size, lost)]
    token, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    made = S.Parities(token, at)
    mine, its = (rng.integers(0, len(sets), 4000) for _ in range(2))
    told, true = made.apart(mine, made, its), np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(mine, its)])
    assert (told <= true).all() and ((told > 0) & (true < 400)).sum() > 100
