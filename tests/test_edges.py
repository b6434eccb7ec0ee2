"""Inputs that the fixtures lack: seeds, interactions, repeated ids, negative durations, many features."""

import datetime as dt

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from dispatchlens import config as C
from dispatchlens.functions import scalars as S
from dispatchlens.operators import evaluate as E
from dispatchlens.operators import explain as X
from dispatchlens.operators import learning as LN
from dispatchlens.operators import trends as TR
from dispatchlens.plans import ordered as O


def test_seeds_draw_different_samples(spark):
    df = spark.range(30_000).withColumnRenamed("id", C.KEY)
    picked = [{r[0] for r in E.seeded_sample(df, 8_000, seed=s).collect()} for s in (42, 7)]
    assert len(picked[0]) == len(picked[1]) == 8_000
    share = len(picked[0] & picked[1]) / 8_000  # independent: 8 of 30
    assert 0.22 < share < 0.32
    split = df.select((S.split_bucket(C.KEY, 0) < 80).alias("a"), (S.split_bucket(C.KEY, 1) < 80).alias("b"))
    a, b, both = split.agg(F.avg(F.col("a").cast("int")), F.avg(F.col("b").cast("int")), F.avg((F.col("a") & F.col("b")).cast("int"))).first()
    assert abs(a - 0.8) < 0.01 and abs(b - 0.8) < 0.01 and abs(both - a * b) < 0.01


class Product:
    """f = a * b * c, and a * b - c * d * e."""

    def __init__(self, expr):
        self.expr = expr

    def transform(self, df):
        return df.withColumn("prediction", F.expr(self.expr))


@pytest.mark.parametrize("expr, want", [
    ("a * b * c", {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}),
    ("a * b - c * d * e", {"a": 1 / 2, "b": 1 / 2, "c": -1 / 3, "d": -1 / 3, "e": -1 / 3})])
def test_shapley_values_of_interactions(spark, expr, want):
    feats = sorted(want)
    rows = spark.createDataFrame([(i, *[1.0] * len(feats)) for i in range(40)], [C.KEY, *feats])
    zero = spark.createDataFrame([(i, *[0.0] * len(feats)) for i in range(5)], [C.KEY, *feats])
    got = X.sampled_shapley(Product(expr), rows, zero, feats, draws=64)
    mean = {r.feature: r.v for r in got.groupBy("feature").agg(F.avg("shapley_value").alias("v")).collect()}
    for f, v in want.items():
        assert abs(mean[f] - v) < 0.04  # 2,560 permutations


def test_exact_pair_agrees_with_sampling_over_all_background_rows(spark):
    train = spark.createDataFrame([(i, "xy"[i % 2], i % 3, float((i % 2) * (i % 3) + 1)) for i in range(60)],
                                  [C.KEY, "BOROUGH", "Hour", C.TARGET])
    rows = spark.createDataFrame([(1, "x", 2), (2, "y", 2), (3, "z", 0)], [C.KEY, "BOROUGH", "Hour"])
    got = {(r[0], r.feature): r.shapley_value for r in X.exact_pair_shapley(train, rows, "BOROUGH", "Hour").collect()}
    f = {("xy"[i % 2], i % 3): float((i % 2) * (i % 3) + 1) for i in range(6)}
    g = sum(f.values()) / 6
    for k, b, h in ((1, "x", 2), (2, "y", 2), (3, "z", 0)):
        both, vb, vh = f.get((b, h), g), sum(f.get((b, j), g) for j in range(3)) / 3, sum(f[(a, h)] for a in "xy") / 2
        assert abs(got[(k, "BOROUGH")] - (vb - g + both - vh) / 2) < 1e-9
        assert abs(got[(k, "Hour")] - (vh - g + both - vb) / 2) < 1e-9


def incidents(spark, copies=2):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), t0 + dt.timedelta(hours=i, minutes=9), "A", "Z1", float(i))
            for i in range(10) for _ in range(copies)]
    return spark.createDataFrame(rows, f"{C.KEY} long, {C.INCIDENT_DATETIME} timestamp_ntz, {C.FIRST_ON_SCENE_DATETIME} timestamp_ntz, "
                                 f"BOROUGH string, INCIDENT_DISPATCH_AREA string, {C.TARGET} double")


def test_repeated_ids(spark):
    df = incidents(spark)
    for n in (1, 5, 6, 19, 20, 21):
        assert O.first_n_by(df, n, [C.INCIDENT_DATETIME, C.KEY]).count() == min(n, 20)
    train, test = E.temporal_split(df, test_fraction=0.25)
    assert (train.count(), test.count()) == (15, 5)
    got = TR.add_area_lastn_avg(df, 5)
    assert got.count() == 20 and got.columns == [*df.columns, "DispatchArea_Last5_Avg"]
    assert got.where("DispatchArea_Last5_Avg IS NULL").count() == 1


def test_first_n_with_nulls_and_one_hot_time(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else 1.0) for i in range(100)], "k long, t double")
    got = O.first_n_by(df, 40, ["t", "k"]).collect()
    want = sorted(((r.t is not None, r.t or 0, r.k) for r in df.collect()))[:40]
    assert sorted((r.t is not None, r.t or 0, r.k) for r in got) == want


def test_incidents_that_end_before_they_start(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    rows = [(1, t[1], t[4]), (2, t[2], t[0]), (3, t[2], t[3]), (4, t[5], t[5]), (5, t[3], None)]
    df = spark.createDataFrame(rows, f"{C.KEY} long, {C.INCIDENT_DATETIME} timestamp_ntz, {C.FIRST_ON_SCENE_DATETIME} timestamp_ntz")
    got = {r[C.KEY]: r.concurrent_incidents for r in TR.add_concurrent_incidents(df).collect()}
    want = {i: sum(j != i and s2 <= s and (e2 is None or e2 > s) for j, s2, e2 in rows) for i, s, e in rows}
    assert got == want and min(got.values()) >= 0


def test_linear_regression_of_many_features(spark):
    rows = [(SparseVector(5_000, {i % 5_000: 1.0}), float(i % 7)) for i in range(300)]
    model = LN.linear().fit(spark.createDataFrame(rows, [LN.FEATURES, C.TARGET]))
    assert model.numFeatures == 5_000


def test_forest_does_not_depend_on_the_input_layout(spark):
    df = spark.range(2_000).select(F.col("id").alias(C.KEY), (F.col("id") % 13).cast("double").alias("Hour"),
                                   ((F.col("id") * 7919) % 101).cast("double").alias(C.TARGET))
    preds = []
    for n in (1, 7):
        model = LN.fit_models(df.repartition(n), ["Hour"], [], {"m": LN.forest(trees=3, depth=4)})["m"]
        preds.append({r[C.KEY]: round(r.prediction, 9) for r in model.transform(df).collect()})
    assert preds[0] == preds[1]


def test_stacking_meta_learner_is_the_ridge_of_its_bases(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(int(i), float(x), float(3 * x + rng.normal())) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, [C.KEY, "Hour", C.TARGET])
    stack = LN.StackingRegressor([LN.linear()], alpha=50.0)
    model = LN.fit_models(df, ["Hour"], [], {"s": stack})["s"].learner
    fold = [r[0] for r in df.orderBy(C.KEY).select(F.pmod(S.key_hash(C.KEY, C.SEED + 1), F.lit(3))).collect()]
    x, y = (np.array([r[k] for r in rows]) for k in (1, 2))
    fold, oof = np.array(fold), np.zeros(300)
    for f in range(3):
        a, b = np.polyfit(x[fold != f], y[fold != f], 1)
        oof[fold == f] = a * x[fold == f] + b
    c = oof - oof.mean()
    assert abs(model.ridge.coefficients[0] - c @ (y - y.mean()) / (c @ c + 50.0)) < 1e-3


def test_text_that_only_spark_reads_as_a_number(spark):
    forms = [("nan", None), ("NaN", None), ("1d", None), ("5f", None), ("2.5D", None), ("0x10", None), ("1_000", None), ("", None), (".", None),
             (" 7 ", 7.0), ("+3.", 3.0), (".5", 0.5), ("1e3", 1000.0), ("-2E-1", -0.2), ("inf", float("inf")), ("-Infinity", float("-inf"))]
    got = spark.createDataFrame(forms, "t string, want double").select(S.to_number("t").alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]
    numbers = spark.createDataFrame([(float("nan"), 3), (2.0, None)], "d double, i long").select(S.to_number("d"), S.to_number("i")).collect()
    assert [tuple(r) for r in numbers] == [(None, 3.0), (2.0, None)]


def test_seconds_that_are_text_nan_fall_back(spark):
    from dispatchlens.operators import clean as CL

    rows = [(1, "01/05/2020 10:00:00 AM", "01/05/2020 10:10:00 AM", "nan", "nan"), (2, "01/05/2020 10:00:00 AM", "01/05/2020 10:10:00 AM", "inf", "300"),
            (3, "01/05/2020 10:00:00 AM", "01/05/2020 10:10:00 AM", "12d", "5f")]
    df = spark.createDataFrame(rows, f"{C.KEY} long, INCIDENT_DATETIME string, FIRST_ON_SCENE_DATETIME string, DISPATCH_RESPONSE_SECONDS_QY string, "
                                     "INCIDENT_RESPONSE_SECONDS_QY string") \
        .selectExpr("*", "'BRONX' AS BOROUGH", "'B1' AS INCIDENT_DISPATCH_AREA", "'X' AS INITIAL_CALL_TYPE", "'X' AS FINAL_CALL_TYPE",
                    "1.0 AS INITIAL_SEVERITY_LEVEL_CODE", "1.0 AS FINAL_SEVERITY_LEVEL_CODE", "'Y' AS VALID_INCIDENT_RSPNS_TIME_INDC",
                    "'N' AS HELD_INDICATOR", "'N' AS REOPEN_INDICATOR", "10451.0D AS ZIPCODE")
    got = {r[C.KEY]: (r.DISPATCH_RESPONSE_SECONDS_QY, r[C.TARGET]) for r in CL.clean_incidents(df).collect()}
    assert got == {1: (0.0, 10.0), 2: (600.0, 5.0), 3: (0.0, 10.0)}
