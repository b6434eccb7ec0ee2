"""Boosted trees against a plain numpy version, on any partitioning, alone and together."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.serializers import CloudPickleSerializer

from dispatchlens.operators import boosting as B


def data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 2, n), rng.integers(0, 40, n) / 4, rng.integers(0, 3, n)], axis=1).astype(float)
    y = 3 * (x[:, 0] > 4) + x[:, 1] * x[:, 2] + rng.normal(size=n)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, Vectors.dense(v), float(t), i % 3) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", "y", "fold"]).repartition(parts)


def plain_tree(x, r, cfg):
    """Nodes of one tree as (path, feature, threshold) in the order of their splits, and its predictions."""
    def best(rows):
        out = (1e-9, None, None)
        part = lambda g, h: g * g / max(h + cfg.l2, 1e-12)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                left = rows[x[rows, f] <= v]
                right = rows[x[rows, f] > v]
                if min(len(left), len(right)) < cfg.min_rows:
                    continue
                gain = part(r[left].sum(), len(left)) + part(r[right].sum(), len(right)) - part(r[rows].sum(), len(rows))
                if gain > out[0] + 1e-7:
                    out = (gain, f, v)
        return out

    leaves, splits, values = [("", np.arange(len(x)))], [], np.zeros(len(x))
    while not cfg.leaves or len(leaves) < cfg.leaves:
        found = [(best(rows) if len(path) < cfg.max_depth else (0, None, None)) for path, rows in leaves]
        k = max(range(len(leaves)), key=lambda i: found[i][0])
        if found[k][1] is None:
            break
        path, rows = leaves.pop(k)
        _, f, v = found[k]
        splits.append((path, f, float(v)))
        leaves += [(path + "l", rows[x[rows, f] <= v]), (path + "r", rows[x[rows, f] > v])]
    for _, rows in leaves:
        values[rows] = r[rows].sum() / (len(rows) + cfg.l2)
    return splits, values


def tree_splits(model, tree):
    out, todo = [], [(0, "")]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] >= 0:
            out.append((path, tree.feature[node], model.edges[tree.feature[node]][tree.bin[node]]))
            todo += [(tree.left[node], path + "l"), (tree.right[node], path + "r")]
    return sorted(out)


@pytest.mark.parametrize("cfg", [
    B.BoostConfig(max_iter=1, max_depth=1, step_size=1.0), B.BoostConfig(max_iter=4, max_depth=3, step_size=0.3),
    B.BoostConfig(max_iter=4, max_depth=6, step_size=0.3, l2=0.0, leaves=7, min_rows=20)])
def test_models_equal_a_plain_version(spark, cfg):
    x, y = data()
    model = B.Boosted(cfg, label="y", key="id").fit(frame(spark, x, y))
    now = np.full(len(y), y.mean())
    for tree in model.trees:
        splits, step = plain_tree(x, y - now, cfg)
        assert tree_splits(model, tree) == sorted(splits)
        now = now + cfg.step_size * step
    assert np.allclose(model.predict(x), now, atol=1e-5)
    got = model.transform(frame(spark, x, y)).select("id", "prediction").toPandas().set_index("id")["prediction"]
    assert np.allclose(got.sort_index().to_numpy(), now, atol=1e-5)
    again = B.BoostedModel.from_json(model.to_json())
    assert np.array_equal(again.predict(x), model.predict(x))
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_order_of_leafwise_growth():
    """Expanding ahead of the order takes nothing but the leaves of the largest gains."""
    rng = np.random.default_rng(5)
    x, y = data(9, 300)
    for leaves in (2, 3, 5, 9, 14):
        cfg = B.BoostConfig(max_depth=5, leaves=leaves, l2=0.0)
        edges = [list(np.unique(x[:, f]))[:-1] for f in range(4)]
        start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
        bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        units = np.rint(-(y - y.mean()) / B.UNIT).astype(np.int64)

        def sums(rows):
            g, h = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int64)
            for f in range(4):
                np.add.at(g, start[f] + bins[rows, f], units[rows])
                np.add.at(h, start[f] + bins[rows, f], 1)
            return g, h

        grow = B.Growing(cfg, start, np.ones(4, bool))
        grow.root(*sums(np.arange(len(y))))
        while wanted := grow.expand():
            place = grow.tree.places(bins)
            grow.scanned(*(np.stack(s) for s in zip(*(sums(np.flatnonzero(place == w)) for w in wanted))))
        model = B.BoostedModel(0.0, 1.0, [grow.finished()], edges, 4)
        assert tree_splits(model, model.trees[0]) == sorted(plain_tree(x, y - y.mean(), cfg)[0])
        assert rng is not None


def test_rows_decide_not_partitions(spark):
    x, y = data(3)
    cfg = B.BoostConfig(max_iter=5, max_depth=4, subsampling_rate=0.8, column_rate=0.5)
    models = [B.Boosted(cfg, label="y", key="id").fit(frame(spark, x, y, parts)) for parts in (1, 5, 70)]
    assert models[0].to_json() == models[1].to_json() == models[2].to_json()
    assert len({tuple(tree_splits(models[0], t)) for t in models[0].trees}) > 1


def test_together_is_alone(spark):
    x, y = data(4)
    a, b = B.BoostConfig(max_iter=3, max_depth=3), B.BoostConfig(max_iter=5, max_depth=4, leaves=6, l2=0.0, min_rows=5)
    df = frame(spark, x, y).persist()
    edges = B.bin_edges(df, 256)
    both = B.fit_together(df, [(a, 0), (b, None), (b, 2)], "y", key="id", fold="fold", edges=edges)
    alone = [B.fit_together(df.where("fold <> 0"), [(a, None)], "y", key="id", edges=edges)[0],
             B.fit_together(df, [(b, None)], "y", key="id", edges=edges)[0],
             B.fit_together(df.where("fold <> 2"), [(b, None)], "y", key="id", edges=edges)[0]]
    assert [m.to_json() for m in both] == [m.to_json() for m in alone]


def test_odd_rows(spark):
    same = frame(spark, np.ones((5, 4)), np.arange(5.0))
    model = B.Boosted(B.BoostConfig(max_iter=3), label="y", key="id").fit(same)
    assert model.predict(np.zeros((2, 4))).tolist() == [2.0, 2.0]
    with pytest.raises(ValueError):
        B.Boosted(B.BoostConfig(max_iter=1), label="y", key="id").fit(same.limit(0))


def test_bundled_sums_and_places_are_those_of_the_features():
    rng = np.random.default_rng(7)
    level, x = rng.integers(0, 5, 500), rng.integers(0, 6, 500)
    bins = np.stack([x, *(level == v for v in range(1, 5)), rng.integers(0, 2, 500), np.zeros(500, int)], axis=1).astype(np.uint8)
    edges = [[0.0, 1.0, 2.0, 3.0, 4.0]] + [[0.0]] * 5 + [[]]
    binary = [1, 2, 3, 4, 5]
    on = bins[:, binary].astype(int)
    bundles = B.Bundles.found(on.T @ on, binary, edges)
    assert sorted(map(sorted, bundles.columns)) == [[0], [1, 2, 3, 4], [5]]
    codes, slot, g = bundles.coded(bins), rng.integers(0, 3, 500), rng.integers(-9, 9, 500).astype(float)
    sums, rows, total, n = B.code_sums(codes, bundles.codes, np.arange(500), slot, 3, g)
    got_g, got_h = bundles.spread(sums, total), bundles.spread(rows, n)
    for s in range(3):
        for f, a in enumerate(bundles.start[:-1]):
            for b in range(len(edges[f]) + 1):
                here = (slot == s) & (bins[:, f] == b)
                assert got_g[s, a + b] == g[here].sum() and got_h[s, a + b] == here.sum()
    tree = B.Tree([3, 0, -1, -1, 5, -1, -1], [0, 2, 0, 0, 0, 0, 0], [1, 3, -1, -1, 5, -1, -1], [2, 4, -1, -1, 6, -1, -1], [0.0] * 7)
    want = tree.places(bins)
    assert np.array_equal(B.code_places(codes, tree, bundles.steps(tree), np.arange(500)), want)
    asked = np.isin(np.arange(7), [2, 5])
    assert np.array_equal(B.code_places(codes, tree, bundles.steps(tree), np.arange(500), asked), np.where(asked[want], want, -1))


def test_large_sums_reach_the_driver_once(spark):
    rdd = spark.sparkContext.parallelize(range(30), 30)
    work = lambda b: [np.full((7, 5), b), np.arange(6) + b]
    for size in (1, 1 << 30):
        got = B.summed(rdd, work, size)
        assert (got[0] == 435).all() and got[0].shape == (7, 5) and got[1].tolist() == [435 + 30 * k for k in range(6)]


def test_packed_sums_and_passing_rows_are_those_of_the_features():
    rng = np.random.default_rng(11)
    sizes = [30, 2, 9, 300, 5, 2]
    bins = np.stack([rng.integers(0, n, 2000) for n in sizes] + [np.zeros(2000, int)], axis=1).astype(np.uint16)
    edges = [[float(v) for v in range(n - 1)] for n in sizes] + [[]]
    on = bins[:, [1, 5]].astype(int)
    bundles = B.Bundles.found(on.T @ on, [1, 5], edges)
    packs, codes = B.Packs(bundles), bundles.coded(bins)
    assert sorted(sum(packs.members, [])) == list(range(len(bundles.codes))) and len(packs.members) < len(bundles.codes)
    packed, slot, g = packs.packed(codes), rng.integers(0, 3, 2000), rng.integers(-9, 9, 2000).astype(float)
    want = B.code_sums(codes, bundles.codes, np.arange(2000), slot, 3, g)
    got = B.code_sums(packed, packs.sizes, np.arange(2000), slot, 3, g)
    for part in (0, 1):
        assert np.array_equal(packs.apart(got[part]), want[part]) and np.array_equal(got[part + 2], want[part + 2])
    tree = B.Tree()
    tree.add(0, 2000, 0.0)
    for node in range(150):  # 151 leaves: more than two words of 64
        f = int(rng.integers(0, len(sizes)))
        tree.feature[node], tree.bin[node] = f, int(rng.integers(0, len(edges[f])))
        tree.left[node], tree.right[node] = tree.add(0, 1, 0.0), tree.add(0, 1, 0.0)
    place, some, shape = tree.places(bins), rng.random(2000) < 0.7, tree.compact()
    ends = np.flatnonzero(shape.feature < 0)
    rows, end = packs.passing(packed, shape, ends, some)
    assert sorted(rows) == list(np.flatnonzero(some)) and np.array_equal(ends[end], place[rows])
    rows, end = packs.passing(packed, shape, ends[::3], some)
    assert sorted(rows) == list(np.flatnonzero(some & np.isin(place, ends[::3]))) and np.array_equal(ends[::3][end], place[rows])


def test_what_tasks_get_does_not_hold_trees(spark, monkeypatch):
    """A round's trees are sent beside its jobs, else every later job carries those of all rounds since a checkpoint."""
    x, y = data(2, 300)
    sizes, summed = [], B.summed

    def seen(rdd, work, size=0):
        sizes.append(len(CloudPickleSerializer().dumps(rdd.func)))
        return summed(rdd, work, size)

    monkeypatch.setattr(B, "summed", seen)
    B.fit_together(frame(spark, x, y), [(B.BoostConfig(max_iter=3, max_depth=6), None)], "y", key="id")
    assert max(sizes[2:]) - min(sizes[2:]) < 500


def test_checkpoints_change_nothing(spark, monkeypatch):
    x, y = data(6, 200)
    models = [(B.BoostConfig(max_iter=5, max_depth=3), 0), (B.BoostConfig(max_iter=3, max_depth=4, leaves=5), None)]
    df = frame(spark, x, y)
    want = [m.to_json() for m in B.fit_together(df, models, "y", key="id", fold="fold")]
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    assert [m.to_json() for m in B.fit_together(df, models, "y", key="id", fold="fold")] == want
