"""As-of values, nearest stations and tree attribution against plain versions."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from dispatchlens.operators import boosting as B
from dispatchlens.operators import explain as X
from dispatchlens.operators import trends as TR
from dispatchlens.plans import ordered


def test_last_known_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), t, rng.choice([None, None, t * 10])) for t in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(5)
    got = {(r.k, r.t): r.known for r in ordered.last_known(df, ["k"], ["t"], "v", "known", partitions=9).collect()}
    last = {}
    for k, t, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert got[k, t] == last[k]


def test_rows_without_key_or_time_have_nothing(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ'2020-01-01 05:10:00'), (2, NULL, TIMESTAMP_NTZ'2020-01-01 05:10:00'),
                      (3, 'a', NULL), (4, 'b', TIMESTAMP_NTZ'2020-01-01 05:10:00'), (5, 'a', TIMESTAMP_NTZ'2020-01-01 02:59:00') AS t(id, k, at)""")
    side = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2020-01-01 03:00:00', 7L), ('a', TIMESTAMP_NTZ'2020-01-01 06:00:00', 8L) AS t(k, hour, n)")
    got = {r.id: r.n for r in TR.add_last_known(df, side, "k", "n", time_col="at").collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None, 5: None}


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * TR.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_station_over_sparse_cells(spark):
    rng = random.Random(2)
    stations = [(i, rng.uniform(50, 62), rng.uniform(5, 25)) for i in range(25)] + [(99, 55.0, 10.0), (98, 55.0, 10.0)]
    incidents = [(i, rng.uniform(48, 64), rng.uniform(3, 27)) for i in range(300)] + [(900, 55.0, 10.0), (901, None, 3.0), (902, 50.0, None)]
    one = spark.createDataFrame(incidents, "id long, lat double, lon double")
    two = spark.createDataFrame(stations, "station_id long, lat double, lon double")
    got = {r.id: (r.station_id, r.distance_km) for r in TR.nearest_station(one, two, key="id", cell=0.5).collect()}
    assert len(got) == len(incidents)
    for i, lat, lon in incidents:
        if lat is None or lon is None:
            assert got[i] == (None, None)
            continue
        d, s = min((round(km(lat, lon, y, x), 6), s) for s, y, x in stations)
        assert got[i][0] == s and abs(got[i][1] - d) < 2e-6
    assert TR.nearest_station(one, two.limit(0), key="id").where("station_id is not null").count() == 0


def test_nearest_station_of_a_dense_place_meets_few_stations(spark):
    """3000 stations in one cell of 0.05 degrees and some far away: default cells follow them, distances stay exact."""
    rng = random.Random(3)
    stations = [(i, rng.uniform(55.0, 55.04), rng.uniform(10.0, 10.04)) for i in range(3000)] + [(5000 + i, 55.0, 10.2 + i / 10) for i in range(3)]
    incidents = [(i, rng.uniform(55.0, 55.04), rng.uniform(10.0, 10.04)) for i in range(60)] + [(900, 55.3, 10.4), (901, 54.0, 9.0), (902, 55.01, 10.3)]
    one = spark.createDataFrame(incidents + incidents[:3], "id long, lat double, lon double")
    two = spark.createDataFrame(stations, "station_id long, lat double, lon double")
    sizes, broadcast = [], TR.broadcast_if_small
    TR.broadcast_if_small = lambda near: sizes.append(near.agg(F.max(F.size("near"))).first()[0]) or broadcast(near)
    try:
        got = TR.nearest_station(one, two, key="id").collect()
    finally:
        TR.broadcast_if_small = broadcast
    assert len(got) == len(incidents) and sizes[0] < 500
    for r in got:
        _, lat, lon = next(i for i in incidents if i[0] == r.id)
        d, s = min((round(km(lat, lon, y, x), 6), s) for s, y, x in stations)
        assert abs(r.distance_km - d) < 2e-6 and r.station_id == s


def test_tree_values_are_those_of_all_subsets():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (200, 4)).astype(float)
    edges = [[0.0, 1.0, 2.0, 3.0]] * 4
    trees = []
    for _ in range(5):  # random trees that meet a feature more than once on a path
        tree, todo = B.Tree(), []
        todo.append((tree.add(0, 200, 1.0), np.arange(200), 0))
        while todo:
            node, rows, depth = todo.pop()
            tree.value[node] = float(rng.normal())
            f, b = int(rng.integers(0, 4)), int(rng.integers(0, 4))
            left, right = rows[x[rows, f] <= b], rows[x[rows, f] > b]
            if depth < 5 and len(left) and len(right):
                tree.feature[node], tree.bin[node] = f, b
                tree.left[node], tree.right[node] = tree.add(0, len(left), 1.0), tree.add(0, len(right), 1.0)
                todo += [(tree.left[node], left, depth + 1), (tree.right[node], right, depth + 1)]
        trees.append(tree)
    model = B.BoostedModel(1.5, 0.3, trees, edges, 4)

    def game(row, known, tree, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        if f in known:
            return game(row, known, tree, tree.left[node] if row[f] <= tree.bin[node] else tree.right[node])
        return sum(tree.rows[c] / tree.rows[node] * game(row, known, tree, c) for c in (tree.left[node], tree.right[node]))

    paths = X.TreePaths(model)
    got = paths.values(x[:20])
    assert np.allclose(got.sum(axis=1), model.predict(x[:20]) - paths.expected)
    for row, values in zip(x[:20], got):
        for j in range(4):
            total = 0.0
            for k in range(4):
                for s in itertools.combinations([i for i in range(4) if i != j], k):
                    w = math.factorial(k) * math.factorial(3 - k) / 24
                    total += w * sum(0.3 * (game(row, {*s, j}, t) - game(row, set(s), t)) for t in trees)
            assert math.isclose(values[j], total, abs_tol=1e-9)


def test_tree_values_in_spark(spark):
    from .test_models import setup, small_boost
    from dispatchlens import config as C
    from dispatchlens.operators import learning as LN

    train, test, num, cat = setup(spark)
    model = LN.fit_models(train, num, cat, {"m": small_boost(4)})["m"]
    sums = {r[C.KEY]: r.s for r in X.tree_shapley(model, test).groupBy(C.KEY).agg(F.sum("shapley_value").alias("s")).collect()}
    expected = X.TreePaths(model.learner).expected
    rows = model.transform(test).select(C.KEY, "prediction").collect()
    assert rows and all(math.isclose(sums[r[C.KEY]], r.prediction - expected, abs_tol=1e-9) for r in rows)
