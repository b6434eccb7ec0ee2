"""Connected components against a union-find."""

import random

from dispatchlens.llm.components import components, merged


def brute(links):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        head[find(a)] = find(b)
    groups = {}
    for x in head:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def parts(labels):
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def test_stars_chains_and_random_links(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-10**9, 10**9), 400)
    links = [(ids[0], x) for x in ids[1:60]] + list(zip(ids[60:160], ids[61:161], strict=True))
    links += [tuple(rng.sample(ids[200:400], 2)) for _ in range(120)] + links[:5]
    df = spark.createDataFrame(links, "a long, b long")
    labels = components(df)
    assert parts(labels) == brute(links)
    more = [(ids[5], ids[150]), (ids[170], ids[171]), (ids[200], ids[0])]
    assert parts(merged(labels, spark.createDataFrame(more, "a long, b long"))) == brute(links + more)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
