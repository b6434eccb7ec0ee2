"""Sources and sinks round trips."""

import os

import pytest
from pyspark.sql import functions as F

from dispatchlens import config as C
from dispatchlens.operators import clean as CL
from dispatchlens.operators import profile as P
from dispatchlens.plans import catalog as K
from dispatchlens.sources import fixtures as FX
from dispatchlens.sources import readers as SR
from dispatchlens.sources import sinks as SK

from .conftest import SF_SMALL


def test_csv_roundtrip_then_clean(spark, tmp_dir):
    raw = FX.incidents_events(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "raw_csv")
    SK.write_clean_csv(raw, path)
    back = SR.read_incidents_csv(spark, path)
    assert back.count() == raw.count()
    assert CL.clean_incidents(back).count() == CL.clean_incidents(raw).count()
    assert SR.read_incidents_csv(spark, path, max_rows=10).count() == 10


def test_missing_csv_raises(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        SR.read_incidents_csv(spark, os.path.join(tmp_dir, "nope.csv"))


def test_training_sample_is_first_by_time(spark):
    raw = FX.incidents_events(spark, SF_SMALL)
    s = SR.training_sample(raw, 50).collect()
    assert len(s) == 50
    want = CL.clean_incidents(raw).orderBy(C.INCIDENT_DATETIME, C.KEY).limit(50).collect()
    assert sorted(r[C.KEY] for r in s) == sorted(r[C.KEY] for r in want)


def test_processed_candidates_and_parquet(spark, tmp_dir):
    clean = K.orders_clean(spark, SF_SMALL)
    csv_path = os.path.join(tmp_dir, "clean.csv")
    SK.write_csv(clean, csv_path)
    pq = os.path.join(tmp_dir, "clean.parquet")
    SK.csv_to_parquet(spark, csv_path, pq)
    got = SR.read_processed(spark, [os.path.join(tmp_dir, "missing.parquet"), pq, csv_path])
    assert got.count() == clean.count()
    with pytest.raises(FileNotFoundError):
        SR.read_processed(spark, [os.path.join(tmp_dir, "x.parquet")])


def test_case_table_requires_key(spark, tmp_dir):
    path = os.path.join(tmp_dir, "nokey.parquet")
    spark.createDataFrame([(1,)], "x int").write.parquet(path)
    with pytest.raises(ValueError):
        SR.read_case_table(spark, path)


def test_model_comparison_rounding(spark, tmp_dir):
    path = os.path.join(tmp_dir, "comparison")
    comp = spark.createDataFrame([("A", 3.5040, 5.19425), ("B", 3.125, 2.0)], "Algorithm string, MAE double, RMSE double")
    SK.write_comparison(comp, path)
    got = {r["Algorithm"]: (r["MAE"], r["RMSE"]) for r in SR.read_model_comparison(spark, path).collect()}
    assert got["A"] == (3.5, 5.19) and got["B"] == (3.12, 2.0)


def test_case_predictions_roundtrip(spark, tmp_dir):
    from dispatchlens.operators import evaluate as E

    df = K.orders_clean(spark, SF_SMALL)
    train, test = E.train_test_split(df)
    cases = E.case_predictions(test, {"Mean": E.GroupMeanRegressor([]).fit(train)})
    path = os.path.join(tmp_dir, "cases")
    SK.write_case_predictions(cases, path)
    back = SR.read_case_predictions(spark, path)
    assert back.count() == cases.count()
    assert dict(back.dtypes)["Mean_Predicted_Minutes"] == "double"
    SK.write_check_cases(cases, os.path.join(tmp_dir, "check"), 5)
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "check")).count() == 5


def test_payload_frame_and_report(spark, tmp_dir):
    pay = SR.payload_frame(spark, [{"Hour": 8, "BOROUGH": "EUROPE"}, {"Hour": 9}])
    assert pay.count() == 2 and pay.first()["BOROUGH"] == "EUROPE"
    df = K.events_clean(spark, SF_SMALL)
    num, cat = CL.feature_columns(df)
    prof = P.profile(df, num + cat)
    SK.write_profile_json(prof, os.path.join(tmp_dir, "profile"))
    assert spark.read.json(os.path.join(tmp_dir, "profile")).first()["rows"] == df.count()
    comp = spark.createDataFrame([("A", 1.0, 2.0), ("B", 0.5, 3.0)], "Algorithm string, MAE double, RMSE double")
    imp = spark.createDataFrame([("x", 0.7)], "Feature string, Importance double")
    rep = SK.report_table(prof, comp, imp)
    best = rep.where(F.col("section") == "best_model").first()
    assert best["key"] == "B"
    path = SK.write_training_dataset(df, tmp_dir)
    assert path.endswith(f"training_dataset_{df.count()}")


def test_union_inputs_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("y", 2, 3.0)], "v string, k int, extra double")
    u = SR.union_inputs([a, b])
    assert u.count() == 2 and set(u.columns) == {"k", "v", "extra"}


def test_prediction_pairs_and_importance_sinks(spark, tmp_dir):
    from dispatchlens.operators import evaluate as E

    df = K.orders_clean(spark, SF_SMALL)
    train, test = E.train_test_split(df)
    models = {"Linear Regression": E.GroupMeanRegressor(["BOROUGH"]).fit(train),
              "Random Forest Regressor": E.GroupMeanRegressor([]).fit(train)}
    cases = E.case_predictions(test, models)
    path = SK.write_prediction_pairs(cases, os.path.join(tmp_dir, "pairs"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Actual_Response_Time_Minutes", "Linear_Regression_Predicted_Minutes",
                            "Random_Forest_Regressor_Predicted_Minutes"]
    imp = spark.createDataFrame([("x", 0.7)], "Feature string, Importance double")
    SK.write_importance(imp, os.path.join(tmp_dir, "imp"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "imp")).count() == 1


def test_load_or_train_falls_back(spark, tmp_dir):
    df = K.orders_clean(spark, SF_SMALL)
    models, how = SR.load_or_train(spark, os.path.join(tmp_dir, "no_models"), df,
                                   names=["Linear Regression"])
    assert how == "trained" and list(models) == ["Linear Regression"]
