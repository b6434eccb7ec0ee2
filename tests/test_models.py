"""Learning invariants: encoding parity, closed forms, stacking, Shapley efficiency."""

import itertools
import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from dispatchlens import config as C
from dispatchlens.operators import clean as CL
from dispatchlens.operators import evaluate as E
from dispatchlens.operators import explain as X
from dispatchlens.operators import learning as LN
from dispatchlens.plans import catalog as K
from dispatchlens.sources import readers as SR

from .conftest import SF_CHECK, SF_SMALL


def small_forest():
    return LN.forest(trees=10, depth=5)


def small_boost(depth=3):
    return LN.boosted(LN.BoostConfig(max_iter=5, max_depth=depth))


def setup(spark, sf=SF_SMALL):
    frame, num, cat = CL.make_model_frame(K.orders_clean(spark, sf))
    train, test = E.train_test_split(frame)
    return train, test, num, cat


def test_one_hot_unseen_equals_first_level(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "BOROUGH string, x double")
    pre = LN.Preprocessor(["x"], ["BOROUGH"]).fit(df)
    test = spark.createDataFrame([("a", 1.0), ("zzz", 1.0), ("b", 1.0)], "BOROUGH string, x double")
    vecs = [r["features"].toArray()[1:] for r in pre.transform(test).collect()]
    assert list(vecs[0]) == [0.0, 0.0] and list(vecs[1]) == [0.0, 0.0] and list(vecs[2]) == [1.0, 0.0]
    assert pre.feature_names == ["x", "BOROUGH_b", "BOROUGH_c"]


def test_linear_one_feature_matches_closed_form(spark):
    df = K.orders_clean(spark, SF_SMALL)
    vec = VectorAssembler(inputCols=["INITIAL_SEVERITY_LEVEL_CODE"], outputCol="features").transform(df)
    m = LN.linear().fit(vec)
    pdf = df.select("INITIAL_SEVERITY_LEVEL_CODE", C.TARGET).toPandas()
    slope, intercept = np.polyfit(pdf["INITIAL_SEVERITY_LEVEL_CODE"], pdf[C.TARGET], 1)
    assert math.isclose(m.coefficients[0], slope, rel_tol=1e-8)
    assert math.isclose(m.intercept, intercept, rel_tol=1e-8)


def test_ridge_scaling_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(size=200)
    alpha = 1.0
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y)], ["_meta", "label"])
    reg = alpha / len(y) * float(np.std(y))
    m = LinearRegression(featuresCol="_meta", labelCol="label", regParam=reg, elasticNetParam=0.0,
                         standardization=False, solver="normal").fit(df)
    assert np.allclose(m.coefficients.toArray(), w, rtol=1e-8, atol=1e-10)


def test_forest_beats_global_mean(spark):
    train, test, num, cat = setup(spark, SF_CHECK)
    models = LN.fit_models(train, num, cat, {"Forest": LN.forest(trees=20, depth=8)})
    models["Mean"] = E.GroupMeanRegressor([]).fit(train)
    comp = {r["Algorithm"]: r["MAE"] for r in E.comparison_table(E.case_predictions(test, models, features=num + cat)).collect()}
    assert comp["Forest"] < comp["Mean"]


def test_stacking_not_worse_than_worst_base(spark):
    train, test, num, cat = setup(spark)
    bases = [small_forest(), small_boost(3), small_boost(2)]
    stack = LN.StackingRegressor(bases, parallelism=4)
    models = LN.fit_models(train, num, cat, {"Stack": stack, "F": bases[0], "A": bases[1], "B": bases[2]})
    comp = {r["Algorithm"]: r["MAE"] for r in E.comparison_table(E.case_predictions(test, models, features=num + cat)).collect()}
    assert comp["Stack"] <= max(comp["F"], comp["A"], comp["B"]) + 1e-9


def test_feature_importance_named(spark):
    train, test, num, cat = setup(spark)
    models = LN.fit_models(train, num, cat, {"F": small_forest()})
    imp = LN.feature_importance(models["F"], 20).collect()
    names = set(models["F"].pre.feature_names)
    assert imp and all(r["Feature"] in names for r in imp)
    assert [r["Importance"] for r in imp] == sorted([r["Importance"] for r in imp], reverse=True)


def test_shapley_efficiency(spark):
    train, test, num, cat = setup(spark)
    models = LN.fit_models(train, num, cat, {"LR": LN.linear()})
    model = models["LR"]
    rows = E.seeded_sample(test, 20)
    draws, n_bg = 8, 10
    shap = X.sampled_shapley(model, rows, train, num + cat, draws=draws, background_rows=n_bg)
    sums = {r[C.KEY]: r["s"] for r in shap.groupBy(C.KEY).agg(F.sum("shapley_value").alias("s")).collect()}
    assert len(sums) == rows.count()
    # efficiency: a row's values sum to f(x) less a mean of background predictions, so to within their range
    fx = {r[C.KEY]: r["prediction"] for r in model.transform(rows).collect()}
    back = [r["prediction"] for r in model.transform(train).collect()]
    for k, s in sums.items():
        assert fx[k] - max(back) - 1e-6 <= s <= fx[k] - min(back) + 1e-6
    assert shap.select("feature").distinct().count() == len(num + cat)


def test_sampled_shapley_keeps_paths_in_their_tasks(spark):
    """Hybrids are summed where they are made; no window over paths."""
    names, rows, df = _points(spark, 3, 4)
    _, back, bg = _points(spark, 3, 1, first=100)
    shap = X.sampled_shapley(Formula("x0 * x1 + x2"), df, bg, names, draws=4, background_rows=1)
    assert "lag(" not in shap._jdf.queryExecution().optimizedPlan().toString()
    got = {(r[C.KEY], r["feature"]): r["shapley_value"] for r in shap.collect()}
    assert len(got) == 12
    for k, *x in rows:
        total = x[0] * x[1] + x[2] - back[0][1] * back[0][2] - back[0][3]
        assert abs(sum(got[k, f] for f in names) - total) < 1e-9 and abs(got[k, "x2"] - (x[2] - back[0][3])) < 1e-9


class Formula:
    """A model given by an expression."""

    def __init__(self, expression):
        self.expression = expression

    def transform(self, df):
        return df.withColumn("prediction", F.expr(self.expression))


def _points(spark, n_features, n, first=0):
    names = [f"x{i}" for i in range(n_features)]
    rng = np.random.default_rng(n + first)
    data = [(first + k, *map(float, rng.integers(-5, 6, n_features))) for k in range(n)]
    return names, data, spark.createDataFrame(data, f"{C.KEY} long, " + ", ".join(f"{f} double" for f in names))


def test_kernel_shapley_matches_enumerated_subsets(spark):
    names, rows, df = _points(spark, 4, 6)
    _, back, bg = _points(spark, 4, 5, first=100)

    def f(x):
        return x[0] * x[1] + (x[2] if x[3] > 0 else -2 * x[0]) + x[2] ** 2

    got = {(r[C.KEY], r["feature"]): r["shapley_value"]
           for r in X.kernel_shapley(Formula("x0 * x1 + IF(x3 > 0, x2, -2 * x0) + x2 * x2"), df, bg, names).collect()}
    assert len(got) == 24
    for k, *x in rows:
        def v(members):
            return np.mean([f([x[i] if i in members else b[i + 1] for i in range(4)]) for b in back])
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (v({*s, i}) - v(set(s)))
                       for n in range(4) for s in itertools.combinations(others, n))
            assert abs(got[k, names[i]] - want) < 1e-9


def test_kernel_shapley_of_a_linear_model_is_exact_with_drawn_coalitions(spark):
    names, rows, df = _points(spark, 12, 5)
    _, back, bg = _points(spark, 12, 4, first=100)
    z, w = X.coalitions(12, 60)
    assert len(z) == 60 and (z.sum(axis=1) % 12 > 0).all() and abs(w.sum() - sum(11 / (s * (12 - s)) for s in range(1, 12))) < 1e-9
    model = Formula(" + ".join(f"{i + 1} * {f}" for i, f in enumerate(names)))
    for r in X.kernel_shapley(model, df, bg, names, most=60).collect():
        i = names.index(r["feature"])
        x = next(row for row in rows if row[0] == r[C.KEY])[i + 1]
        assert abs(r["shapley_value"] - (i + 1) * (x - np.mean([b[i + 1] for b in back]))) < 1e-8


def test_kernel_shapley_edges(spark):
    names, _, df = _points(spark, 1, 3)
    one = X.kernel_shapley(Formula("3 * x0"), df.union(df), df.limit(1), names)
    assert {r[C.KEY] for r in one.collect()} == {0, 1, 2} and one.count() == 3
    origin = df.limit(1).first()["x0"]
    assert all(abs(r["shapley_value"] - 3 * (r["x0"] - origin)) < 1e-9 for r in one.join(df, C.KEY).collect())
    assert X.kernel_shapley(Formula("x0"), df.limit(0), df, names).count() == 0
    for bad in (lambda: X.kernel_shapley(Formula("x0"), df, df.limit(0), names), lambda: X.coalitions(12, 23)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("expected an error")


def test_partial_dependence_grid(spark):
    train, test, num, cat = setup(spark)
    model = E.GroupMeanRegressor(["BOROUGH", "Hour"]).fit(train)
    pd_ = X.partial_dependence(model, test, "Hour", list(range(24))).collect()
    assert [r["Hour"] for r in pd_] == list(range(24))


def test_cluster_profile_counts(spark):
    df = K.orders_clean(spark, SF_SMALL)
    prof = LN.cluster_profile(df, k=4).collect()
    assert len(prof) == 4 and sum(r["cases"] for r in prof) == df.count()


def test_random_search_draws_are_distinct():
    est = LN.forest()
    maps = LN.sample_param_maps(est, LN.FOREST_SPACE, draws=20)
    assert len({tuple(sorted((p.name, v) for p, v in m.items())) for m in maps}) == 20


def test_random_search_runs(spark):
    train, test, num, cat = setup(spark)
    pre = LN.Preprocessor(num, cat).fit(train)
    prepared = pre.transform(train).select("features", C.TARGET)
    space = {"numTrees": [3, 5], "maxDepth": [2, 3]}
    cv = LN.random_search(LN.forest(), space, prepared, draws=2, folds=2)
    assert len(cv.avgMetrics) == 2


def test_model_save_load_roundtrip(spark, tmp_dir):
    train, test, num, cat = setup(spark)
    models = LN.fit_models(train, num, cat, {"Linear Regression": LN.linear()})
    SR.save_models(models, tmp_dir)
    loaded = SR.load_models(spark, tmp_dir, ["Linear Regression", "Random Forest Regressor"])
    a = models["Linear Regression"].transform(test).select(C.KEY, "prediction").orderBy(C.KEY).collect()
    b = loaded["Linear Regression"].transform(test).select(C.KEY, "prediction").orderBy(C.KEY).collect()
    assert a == b and "Random Forest Regressor" not in loaded


def test_boosted_and_stack_roundtrip(spark, tmp_dir):
    train, test, num, cat = setup(spark)
    models = LN.fit_models(train, num, cat, {"Stack": LN.StackingRegressor([small_forest(), small_boost(2)], parallelism=2),
                                             "Boost": small_boost(3)})
    SR.save_models(models, tmp_dir)
    loaded = SR.load_models(spark, tmp_dir, ["Stack", "Boost"])
    for name in models:
        a, b = (m[name].transform(test).select(C.KEY, "prediction").orderBy(C.KEY).collect() for m in (models, loaded))
        assert a == b


def test_boosted_search_table(spark):
    train, _, num, cat = setup(spark)
    pre = LN.Preprocessor(num, cat).fit(train)
    prepared = pre.transform(train).select(C.KEY, "features", C.TARGET)
    space = {"max_iter": [2, 3], "max_depth": [1, 3], "subsampling_rate": [0.7, 1.0]}
    table, model = LN.search_boosted(prepared, draws=3, folds=2, space=space)
    rows = table.orderBy("draw").collect()
    assert len(rows) == 3 and sum(r.chosen for r in rows) == 1
    best = min(rows, key=lambda r: (r.mean_mae, r.draw))
    assert best.chosen and len(model.trees) == __import__("json").loads(best.parameters)["max_iter"]


def test_propensity_strata_cover_rows(spark):
    from dispatchlens.operators import causal as CA

    frame, num, cat = CL.make_model_frame(K.orders_clean(spark, SF_SMALL))
    strata = CA.propensity_strata(frame, "BOROUGH", ["EUROPE"], num, cat, strata=10)
    rows = strata.collect()
    assert sum(r["treated_cases"] + r["control_cases"] for r in rows) == frame.count()
    att = CA.att_from_strata(strata).first()
    assert att["strata_used"] >= 1 and math.isfinite(att["att_minutes"])
