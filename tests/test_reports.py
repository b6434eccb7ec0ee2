"""Report, feature and evaluation invariants on the fixture views."""

import math

from pyspark.sql import functions as F

from dispatchlens import config as C
from dispatchlens.operators import evaluate as E
from dispatchlens.operators import features as FE
from dispatchlens.operators import profile as P
from dispatchlens.operators import reports as R
from dispatchlens.plans import catalog as K

from .conftest import SF_SMALL


def test_histogram_bins_sum_to_count(spark):
    df = K.events_clean(spark, SF_SMALL)
    h = R.histogram(df).collect()
    assert len(h) == 50
    assert sum(r["count"] for r in h) == df.count()


def test_borough_summary_opportunity(spark):
    df = K.events_clean(spark, SF_SMALL)
    g = df.agg(F.avg(C.TARGET)).first()[0]
    for r in R.borough_summary(df).collect():
        assert math.isclose(r["opportunity_minutes"], max(r["mean_minutes"] - g, 0) * r["cases"], rel_tol=1e-9)
        assert r["median_minutes"] <= r["p90_minutes"]


def test_target_encoding_between_group_and_global(spark):
    df = K.events_clean(spark, SF_SMALL)
    enc = FE.add_target_encoding(df)
    g = df.agg(F.avg(C.TARGET)).first()[0]
    means = {r["BOROUGH"]: r["m"] for r in df.groupBy("BOROUGH").agg(F.avg(C.TARGET).alias("m")).collect()}
    for r in enc.select("BOROUGH", "Borough_TargetEnc").distinct().collect():
        lo, hi = sorted([means[r["BOROUGH"]], g])
        assert lo - 1e-9 <= r["Borough_TargetEnc"] <= hi + 1e-9


def test_unseen_key_gets_global_mean(spark):
    df = K.events_clean(spark, SF_SMALL)
    lk = FE.fit_lookups(df)
    payload = spark.createDataFrame([(1, 3, 0, 1, 2.0, 2.0, "NOWHERE", "NONE", "NA", 0.0, "0", 0, 0)],
                                    "payload_id long, Hour int, DayOfWeek int, Month int, "
                                    "INITIAL_SEVERITY_LEVEL_CODE double, FINAL_SEVERITY_LEVEL_CODE double, "
                                    "BOROUGH string, INCIDENT_CLASSIFICATION string, INCIDENT_DISPATCH_AREA string, "
                                    "DISPATCH_RESPONSE_SECONDS_QY double, ZIPCODE string, IsHeld int, IsReopen int")
    feats = ["Borough_Hour_Avg", "Borough_TargetEnc", "Hour_sin", "BOROUGH"]
    row = FE.prediction_input(payload, lk, feats, ["BOROUGH"]).first()
    assert row["Borough_Hour_Avg"] == lk.global_mean and row["Borough_TargetEnc"] == lk.global_mean


def test_duplicate_count_hash_first(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    assert P.duplicate_count(df).first()[0] == 3


def test_missing_counts_long_form(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0), (None, float("nan"))], "a int, b double")
    got = {r["column_name"]: r["missing"] for r in P.missing_counts(df).collect()}
    assert got == {"a": 2, "b": 2}


def test_mae_not_above_rmse_and_lookup_beats_nothing(spark):
    df = K.orders_clean(spark, SF_SMALL)
    train, test = E.train_test_split(df)
    model = E.GroupMeanRegressor(["BOROUGH", "Hour"]).fit(train)
    m = E.regression_metrics(model.transform(test)).first()
    assert m["MAE"] <= m["RMSE"]


def test_case_predictions_error_sign(spark):
    df = K.orders_clean(spark, SF_SMALL)
    train, test = E.train_test_split(df)
    cases = E.case_predictions(test, {"Global Mean": E.GroupMeanRegressor([]).fit(train)})
    r = cases.first()
    assert math.isclose(r["Global_Mean_Error_Minutes"],
                        r["Global_Mean_Predicted_Minutes"] - r["Actual_Response_Time_Minutes"])


def test_lookup_cases_text_key(spark):
    df = K.orders_clean(spark, SF_SMALL)
    some = df.select(C.KEY).limit(3).collect()
    ids = spark.createDataFrame([(str(r[0]),) for r in some] + [("missing",)], "case_id string")
    got = E.lookup_cases(df, ids)
    assert got.count() == 3


def test_temporal_split_sizes(spark):
    df = K.orders_clean(spark, SF_SMALL)
    n = df.count()
    train, test = E.temporal_split(df)
    assert train.count() == int(n * 0.8) and test.count() == n - int(n * 0.8)
    assert train.agg(F.max(C.INCIDENT_DATETIME)).first()[0] <= test.agg(F.min(C.INCIDENT_DATETIME)).first()[0]


def test_segmented_errors_cover_all_rows(spark):
    df = K.orders_clean(spark, SF_SMALL)
    train, test = E.train_test_split(df)
    res = E.residual_frame(E.GroupMeanRegressor(["BOROUGH"]).fit(train).transform(test),
                           context=["BOROUGH", "Hour"])
    seg = E.segmented_errors(res, ["BOROUGH", "Hour"]).collect()
    n = res.count()
    for s in ["BOROUGH", "Hour"]:
        assert sum(r["cases"] for r in seg if r["segment"] == s) == n


def test_priority_labels(spark):
    df = K.events_clean(spark, SF_SMALL)
    labels = {r["priority"] for r in R.dispatch_area_summary(df, min_cases=1).collect()}
    assert labels <= {"high", "medium", "watch"}


def test_seeded_sample_prefilter_is_exact(spark):
    df = spark.range(50000).select(F.col("id").alias(C.KEY))
    filtered = sorted(r[0] for r in E.seeded_sample(df, 100).collect())
    from dispatchlens.functions import scalars as S
    want = sorted(r[0] for r in df.orderBy(S.key_hash(C.KEY, C.SEED), C.KEY).limit(100).collect())
    assert filtered == want and len(filtered) == 100
