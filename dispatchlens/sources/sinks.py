"""Writers (K1–K8, K10, K11).  All are DataFrame writers; nothing is collected.

Single-row or tiny reports are coalesced to one file; data-sized outputs keep
their partitioning so the write is parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_clean_csv(df: DataFrame, path: str) -> str:
    """K1: cleaned incidents as CSV."""
    return write_csv(df, path)


def write_training_dataset(df: DataFrame, directory: str, fmt: str = "parquet") -> str:
    """K2: training dataset, row count in the folder name."""
    n = df.count()
    path = f"{directory.rstrip('/')}/training_dataset_{n}"
    if fmt == "csv":
        return write_csv(df, path)
    df.write.mode("overwrite").parquet(path)
    return path


def write_profile_json(profile: DataFrame, path: str) -> str:
    """K3: the one-row profile as JSON."""
    profile.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_comparison(comparison: DataFrame, path: str) -> str:
    """K4: model comparison CSV."""
    return write_csv(comparison, path, single_file=True)


def write_importance(importance: DataFrame, path: str) -> str:
    """K5: feature importance CSV."""
    return write_csv(importance, path, single_file=True)


def write_case_predictions(cases: DataFrame, path: str, fmt: str = "csv") -> str:
    """K6: case-level predictions (CSV or Parquet)."""
    if fmt == "parquet":
        cases.write.mode("overwrite").parquet(path)
        return path
    return write_csv(cases, path)


def write_check_cases(cases: DataFrame, path: str, n: int = 20) -> str:
    """K7: the first n cases by key, for manual checking."""
    return write_csv(cases.orderBy(C.KEY).limit(n), path, single_file=True)


def write_prediction_pairs(cases: DataFrame, path: str,
                           models: tuple[str, ...] = ("Linear_Regression", "Random_Forest_Regressor")) -> str:
    """K8: actual minutes plus the predictions of the named models."""
    cols = [F.col("Actual_Response_Time_Minutes")] + [
        F.col(f"{m}_Predicted_Minutes") for m in models if f"{m}_Predicted_Minutes" in cases.columns]
    return write_csv(cases.select(*cols), path)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: str | None = None) -> str:
    """Convert a CSV table to Parquet (header; types by ``schema``, else by column name)."""
    from .readers import csv_schema

    reader = spark.read.option("header", True)
    reader.schema(schema or csv_schema(reader.csv(src).columns)).csv(src).write.mode("overwrite").parquet(dst)
    return dst


def report_table(profile: DataFrame, comparison: DataFrame, importance: DataFrame) -> DataFrame:
    """The content of the final report as rows (section, key, value)."""
    def field(name, value):
        return profile.select(F.lit("data").alias("section"), F.lit(name).alias("key"),
                              value.cast("string").alias("value"))

    p = field("rows", F.col("rows"))
    for name in ["columns", "duplicate_rows", "selected_features"]:
        p = p.unionByName(field(name, F.col(name)))
    comp = comparison.select(F.lit("comparison").alias("section"), F.col("Algorithm").alias("key"),
                             F.format_string("MAE=%.4f RMSE=%.4f", "MAE", "RMSE").alias("value"))
    imp = importance.select(F.lit("importance").alias("section"), F.col("Feature").alias("key"),
                            F.format_string("%.4f", "Importance").alias("value"))
    best = comparison.orderBy("MAE", "RMSE").limit(1).select(
        F.lit("best_model").alias("section"), F.col("Algorithm").alias("key"),
        F.format_string("MAE=%.4f RMSE=%.4f", "MAE", "RMSE").alias("value"))
    return p.unionByName(comp).unionByName(imp).unionByName(best)
