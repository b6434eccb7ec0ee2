"""Model explanation as Spark jobs.

* ``partial_dependence`` (M19): every row is re-scored once per grid value by
  exploding a fixed, small grid array; one ``transform`` scores all copies and
  one ``groupBy(grid)`` averages them.  Cost is rows x grid, all distributed.
* ``sampled_shapley`` (M18, re-aimed from per-row tree / kernel solvers): the
  sampling estimator of Strumbelj and Kononenko.  For every explained row and
  every draw m = 1..M a background row and a feature permutation (both by
  ``xxhash64`` of seed, row and draw) are chosen; the F+1 hybrid rows along the
  permutation path are scored in one ``transform``; each prediction counts for the
  feature added at its step and against the one added next, so the consecutive
  differences add up in one ``groupBy(row)`` and no path is shuffled.  The
  values of a row sum exactly to f(x) minus the mean background prediction.
  The background table is bounded by ``background_rows`` and joined on an
  equi-key with a broadcast.
* ``kernel_shapley`` (M18, any model): weighted least squares over coalitions of
  features.  All rows share the coalitions, so the normal equations are solved once
  and a row's values are one weighted sum of its predictions.
* ``exact_pair_shapley`` and ``linear_shapley`` (M18): closed forms for a
  predictor of two features by group means, and for a linear model.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..plans.joins import materialize


def partial_dependence(model, df: DataFrame, feature: str, grid: Sequence,
                       prediction_col: str = "prediction") -> DataFrame:
    """Average prediction with ``feature`` set to each grid value."""
    dtype = df.schema[feature].dataType
    values = F.array(*[F.lit(v).cast(dtype) for v in grid])
    others = [c for c in df.columns if c != feature]
    expanded = df.select(*others, F.explode(values).alias(feature))
    scored = model.transform(expanded)
    return (scored.groupBy(feature).agg(F.avg(prediction_col).alias("partial_dependence"))
                  .orderBy(feature))


def sampled_shapley(model, rows: DataFrame, background: DataFrame, features: Sequence[str],
                    key: str = C.KEY, draws: int = 32, background_rows: int = 50,
                    seed: int = C.SEED, prediction_col: str = "prediction") -> DataFrame:
    """Sampled Shapley values, long form (key, feature, shapley_value)."""
    feats = list(features)
    nf = len(feats)
    bg = (background.orderBy(F.xxhash64(F.lit(seed), key), key).limit(background_rows)
                    .select(*feats).withColumn("_b", F.row_number().over(Window.orderBy(*feats)) - 1))
    bg = bg.select("_b", *[F.col(f).alias(f"_bg_{i}") for i, f in enumerate(feats)])
    n_bg = bg.count()
    if n_bg == 0:
        raise ValueError("empty background")
    base = rows.select(key, *feats)
    draw = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_m"))
    draw = draw.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), key, "_m", F.lit(-1)), F.lit(n_bg)))
    # permutation: feature indexes ordered by a keyed hash of (row, draw, feature)
    perm = F.transform(
        F.array_sort(F.array(*[F.struct(
            F.xxhash64(F.lit(seed), key, "_m", F.lit(i)).alias("h"),
            F.lit(i).alias("i")) for i in range(nf)])),
        lambda s: s["i"])
    draw = draw.withColumn("_perm", perm).join(F.broadcast(bg), "_b")
    steps = draw.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("_s"))
    hybrid_cols = []
    for i, f in enumerate(feats):
        pos = F.array_position(F.col("_perm"), F.lit(i)) - 1
        hybrid_cols.append(F.when(pos < F.col("_s"), F.col(f)).otherwise(F.col(f"_bg_{i}")).alias(f))
    hybrid = steps.select(key, "_m", "_s", "_perm", *hybrid_cols)
    # A step's prediction counts for the feature it adds and against the next one's, so a row's
    # hybrids are summed in their own task.  Copies of a row make one path, averaged over them all.
    n, p = F.count_if(F.col("_s") == 0), F.col(prediction_col)
    values = model.transform(hybrid).groupBy(key).agg(n.alias("_n"), *[
        F.sum(F.when(F.get("_perm", F.col("_s") - 1) == i, p).when(F.get("_perm", F.col("_s")) == i, -p)).alias(f"_v_{i}") for i in range(nf)])
    return values.select(key, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f"_v_{i}") / F.col("_n") * F.lit(draws) / F.col("_n")).alias("shapley_value"))
        for i, f in enumerate(feats)])))


def coalitions(n: int, most: int, seed: int = C.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Proper coalitions of ``n`` features, one a row, and their kernel weights.

    All of them where ``most`` allows; else whole sizes, the smallest and largest
    first, and pairs of a set and its complement drawn from the sizes between.
    """
    mass = {s: (n - 1) / (s * (n - s)) for s in range(1, n)}
    sets, weights, left = [], [], most
    for s in range(1, n // 2 + 1):
        sizes = {s, n - s}
        if math.comb(n, s) * len(sizes) > left:
            break
        for size in sorted(sizes):
            found = list(itertools.combinations(range(n), size))
            sets += found
            weights += [mass[size] / len(found)] * len(found)
            left -= len(found)
            del mass[size]
    if mass:
        if most < 2 * n:
            raise ValueError(f"{n} features need {2 * n} coalitions at least")
        rng = np.random.default_rng(seed)
        sizes, pairs = list(mass), left // 2
        rate = np.array([mass[s] for s in sizes])
        for size in rng.choice(sizes, pairs, p=rate / rate.sum()):
            chosen = rng.permutation(n)
            sets += [chosen[:size], chosen[size:]]
        weights += [rate.sum() / (2 * pairs)] * (2 * pairs) if pairs else []
    z = np.zeros((len(sets), n))
    for row, members in zip(z, sets, strict=True):
        row[list(members)] = 1.0
    return z, np.array(weights)


def kernel_solution(n: int, most: int, seed: int = C.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions, the empty one first and the whole last, and the n x coalitions matrix that turns their values into Shapley values.

    Least squares under the constraint that a row's values sum to the whole less the empty
    coalition; the last feature is eliminated by it.
    """
    z, w = coalitions(n, most, seed)
    every = np.vstack([np.zeros(n), z, np.ones(n)])
    solution = np.zeros((n, len(every)))
    if n > 1:
        x, last = z[:, :-1] - z[:, -1:], z[:, -1]
        k = np.linalg.solve(x.T @ (w[:, None] * x), (w[:, None] * x).T)
        solution[:-1, 1:-1] = k
        solution[:-1, 0], solution[:-1, -1] = k @ last - k.sum(axis=1), -(k @ last)
    solution[-1] = -solution[:-1].sum(axis=0)
    solution[-1, 0] -= 1.0
    solution[-1, -1] += 1.0
    return every, solution


def kernel_shapley(model, rows: DataFrame, background: DataFrame, features: Sequence[str], key: str = C.KEY,
                   most: int | None = None, background_rows: int = 50, seed: int = C.SEED,
                   prediction_col: str = "prediction") -> DataFrame:
    """M18 for any model with ``transform``: long form (key, feature, shapley_value).

    The value of a coalition is the mean prediction with its features taken from the row
    and the others from ``background_rows`` rows of ``background`` (the first by a hash of
    the row).  ``most`` coalitions, 2 * features + 64 if not given; exact where these are
    all, and for linear models always.  A row is scored (coalitions + 2) x background rows
    times in one task, and summed there before the one shuffle by key.  Rows of an
    equal key get the mean of their values; without background rows it is an error.
    """
    feats = list(features)
    every, solution = kernel_solution(len(feats), 2 * len(feats) + 64 if most is None else most, seed)
    spark = rows.sparkSession
    kept = background.select(*[F.col(f).alias(f"_bg_{i}") for i, f in enumerate(feats)])
    names = kept.columns
    first = kept.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(background_rows)
    first = first.agg(F.collect_list(F.struct(*names)).alias("_all")).select(F.posexplode("_all").alias("_b", "_r")).select("_b", "_r.*")
    first = materialize(first)  # background_rows rows at most
    n_bg = first.count()
    if n_bg == 0:
        raise ValueError("empty background")
    sets = spark.createDataFrame(
        [(c, [bool(x) for x in every[c]], solution[:, c].tolist()) for c in range(len(every))],
        "_c int, _in array<boolean>, _share array<double>")
    wide = rows.select(key, *[F.col(f).alias(f"_x_{i}") for i, f in enumerate(feats)],
                       F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))).alias("_c")).join(F.broadcast(sets), "_c")
    wide = wide.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_bg - 1)))).join(F.broadcast(first), "_b")
    mixed = wide.select(key, "_share", *[F.when(F.col("_in")[i], F.col(f"_x_{i}")).otherwise(F.col(f"_bg_{i}")).alias(f)
                                         for i, f in enumerate(feats)])
    p = F.col(prediction_col) * F.lit(len(every))
    values = model.transform(mixed).groupBy(key).agg(
        *[F.avg(p * F.col("_share")[i]).alias(f"_v_{i}") for i in range(len(feats))])
    return values.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_v_{i}").alias("shapley_value"))
                                                 for i, f in enumerate(feats)])))


def exact_pair_shapley(train: DataFrame, rows: DataFrame, a: str, b: str, key: str = C.KEY,
                       label: str = C.TARGET) -> DataFrame:
    """M18 in closed form for the group-mean predictor of two features, with all training rows as background.

    ``v`` of a set of features is the mean prediction with these taken from the row
    and the others from the background: the training counts of one feature, and the
    global mean where a pair was never seen.  Each feature gets the mean of what it
    adds alone and what it adds last.  Long form (key, feature, shapley_value).
    """
    y = F.col(label)
    pairs = train.where(F.col(a).isNotNull() & F.col(b).isNotNull() & y.isNotNull()) \
        .groupBy(a, b).agg(F.avg(y).alias("_f"), F.count(y).alias("_n"), F.sum(y).alias("_s"))
    pairs = pairs.persist()
    total = pairs.agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    n, g = float(total["n"] or 0), float(total["s"] or 0.0) / (total["n"] or 1)

    def alone(own: str, other: str) -> DataFrame:
        weight = pairs.groupBy(other).agg(F.sum("_n").alias("_w"))
        seen = pairs.join(weight, other).groupBy(own).agg(F.sum(F.col("_f") * F.col("_w")).alias("_x"), F.sum("_w").alias("_w"))
        return seen.select(own, ((F.col("_x") + F.lit(g) * (F.lit(n) - F.col("_w"))) / F.lit(n)).alias(f"_v_{own}"))

    out = rows.select(key, a, b).join(pairs.select(a, b, "_f"), [a, b], "left") \
        .join(alone(a, b), a, "left").join(alone(b, a), b, "left")
    both, va, vb, none = (F.coalesce(c, F.lit(g)) for c in (F.col("_f"), F.col(f"_v_{a}"), F.col(f"_v_{b}"), F.lit(g)))
    values = F.array(F.struct(F.lit(a).alias("feature"), ((va - none + both - vb) / 2).alias("shapley_value")),
                     F.struct(F.lit(b).alias("feature"), ((vb - none + both - va) / 2).alias("shapley_value")))
    return out.select(key, F.inline(values))


def linear_shapley(rows: DataFrame, coefficients: dict[str, float], means: dict[str, float], key: str = C.KEY) -> DataFrame:
    """M18 in closed form for a linear model: coefficient times the distance from the feature's training mean."""
    values = F.array(*(F.struct(F.lit(f).alias("feature"), (F.lit(c) * (F.col(f) - F.lit(means[f]))).alias("shapley_value"))
                       for f, c in coefficients.items()))
    return rows.select(key, F.inline(values))


class TreePaths:
    """Exact path-dependent Shapley values of an ensemble of trees.

    A feature that is not known sends a row down both sides by their training rows.  A
    leaf's part in a value then only depends on which of the distinct features on its
    path let the row through, at most 2^depth cases, which are worked out once: the sum
    over all subsets of the other features is a polynomial's, built factor by factor.
    """

    def __init__(self, model):
        self.model, self.leaves, self.expected = model, [], model.base
        for tree in model.trees:
            todo = [(0, {}, 1.0)]
            while todo:
                node, path, share = todo.pop()
                if tree.feature[node] >= 0:
                    f, b = tree.feature[node], tree.bin[node]
                    low, high, zero = path.get(f, (-1, 1 << 30, 1.0))
                    for child, span in ((tree.left[node], (low, min(high, b))), (tree.right[node], (max(low, b), high))):
                        part = tree.rows[child] / tree.rows[node]
                        todo.append((child, {**path, f: (*span, zero * part)}, share * part))
                    continue
                value = model.rate * tree.value[node]
                self.expected += value * share
                if path:
                    features = list(path)
                    self.leaves.append((features, [path[f][:2] for f in features], value * self.cases([path[f][2] for f in features])))

    @staticmethod
    def cases(zero: list[float]) -> np.ndarray:
        """Of each case (a bit per feature that lets the row through) the value of each feature, for a leaf of value 1."""
        d = len(zero)
        one = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
        weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        out = np.zeros((1 << d, d))
        for j in range(d):
            sums = np.zeros((1 << d, d))
            sums[:, 0] = 1
            for i in range(d):
                if i != j:
                    grown = sums * zero[i]
                    grown[:, 1:] += sums[:, :-1] * one[:, i:i + 1]
                    sums = grown
            out[:, j] = (one[:, j] - zero[j]) * (sums @ weight)
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """Rows x features; a row's values add up to its prediction less ``expected``."""
        bins, out = self.model.binned(x), np.zeros((len(x), self.model.n_features))
        for features, spans, table in self.leaves:
            case = np.zeros(len(x), np.int64)
            for k, (f, (low, high)) in enumerate(zip(features, spans)):
                case |= ((bins[:, f] > low) & (bins[:, f] <= high)).astype(np.int64) << k
            out[:, features] += table[case]
        return out


def tree_shapley(model, rows: DataFrame, key: str = C.KEY) -> DataFrame:
    """M18 for boosted trees: exact values of every model feature, long form (key, feature, shapley_value).

    ``model`` is a fitted preprocessor with boosted trees; all ``rows`` are explained, in Arrow batches.
    """
    paths = rows.sparkSession.sparkContext.broadcast(TreePaths(model.learner))

    def run(x: pd.Series) -> pd.Series:
        made = paths.value.values(np.stack(x.to_numpy())) if len(x) else np.zeros((0, 0))
        return pd.Series(list(made))

    values = F.pandas_udf(run, "array<double>")(vector_to_array(F.col("features")))
    names = F.array(*map(F.lit, model.pre.feature_names))
    pairs = F.arrays_zip(names.alias("feature"), values.alias("shapley_value"))
    return model.pre.transform(rows).select(key, F.inline(pairs))


def attribution_summary(shap: DataFrame, k: int = 15) -> DataFrame:
    """Mean absolute attribution per feature, top k."""
    return (shap.groupBy("feature").agg(F.avg(F.abs("shapley_value")).alias("mean_abs_attribution"))
                .orderBy(F.col("mean_abs_attribution").desc(), "feature").limit(k))
