"""Splits, a lookup predictor, case tables and error analysis
(M9, M10, M13, M21, P10, P14–P16, P18, P20, A19, A28–A32, A40–A42, O2).

* The train/test split is a deterministic function of the incident key (T12),
  so it needs no shuffle, is identical on every re-run and after executor loss,
  and can be repeated in plain SQL.
* ``GroupMeanRegressor`` is the SQL-expressible predictor: the mean target per
  key group on the training rows with the global training mean as fallback.
  Its fitted table is materialized and broadcast only below a measured size.
* All per-model metrics work on a long (case, model) form obtained with
  ``unpivot``; one ``groupBy(model)`` then computes every model's metrics in a
  single pass instead of one pass per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from ..plans.joins import DEFAULT_BROADCAST_BYTES, broadcast_if_small, materialize, measured_bytes
from ..plans.ordered import first_n_by, split_at
from . import reports as R

ACTUAL = "Actual_Response_Time_Minutes"
PRED_SUFFIX = "_Predicted_Minutes"
ERR_SUFFIX = "_Error_Minutes"


# --- M9 / M10 / M21: splits and samples -------------------------------------
def split_flag(key: str = C.KEY, seed: int = 0, train_percent: int = 80) -> Column:
    return S.split_bucket(key, seed) < F.lit(train_percent)


def train_test_split(df: DataFrame, key: str = C.KEY, test_fraction: float = C.TEST_FRACTION,
                     seed: int = 0, min_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M9: deterministic hash split on the incident key (80/20 by default).

    ``min_rows`` (the reference requires 10) triggers a cheap bounded check.
    """
    if min_rows:
        if df.limit(min_rows).count() < min_rows:
            raise ValueError(f"a split for training needs {min_rows} usable rows")
    pct = int(round((1.0 - test_fraction) * 100))
    flag = split_flag(key, seed, pct)
    return df.where(flag), df.where(~flag)


def temporal_split(df: DataFrame, time_col: str = C.INCIDENT_DATETIME, key: str = C.KEY,
                   test_fraction: float = C.TEST_FRACTION) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * (1 - test)) rows in (time, key) order train.

    Nothing needs to be unique: rows of equal time and key are told apart by a
    hash of the whole row, and of identical rows as many as needed train.  Only
    the rows around the cut are sorted (``plans.ordered.split_at``).
    """
    return split_at(df, lambda n: int(n * (1.0 - test_fraction)), [time_col, key])


def seeded_sample(df: DataFrame, n: int, key: str = C.KEY, seed: int = C.SEED) -> DataFrame:
    """The n rows with the smallest keyed hash (without replacement).

    Exact and distributed: ``plans.ordered.first_n_by`` cuts on the hash
    (uniform over 2^32), and the sample keeps the input's partitioning.
    """
    hashed = df.withColumn("_h", S.key_hash(key, seed))
    return first_n_by(hashed, n, ["_h", key]).drop("_h")


# --- lookup predictor --------------------------------------------------------
class GroupMeanModel:
    """Fitted group-mean predictor (see ``GroupMeanRegressor``)."""

    def __init__(self, keys: list[str], table: DataFrame | None, small: bool, global_mean: float,
                 prediction_col: str = "prediction"):
        self.keys, self.table, self.small = keys, table, small
        self.global_mean, self.prediction_col = global_mean, prediction_col

    def transform(self, df: DataFrame) -> DataFrame:
        fallback = F.lit(self.global_mean)
        if not self.keys:
            return df.withColumn(self.prediction_col, fallback)
        table = self.table.withColumnRenamed("_mean", "_lookup_mean")
        joined = df.join(F.broadcast(table) if self.small else table, self.keys, "left")
        return (joined.withColumn(self.prediction_col, F.coalesce(F.col("_lookup_mean"), fallback))
                      .drop("_lookup_mean").select(*df.columns, self.prediction_col))


class GroupMeanRegressor:
    """Mean target per key group, global mean for unseen groups."""

    def __init__(self, keys: Sequence[str], label_col: str = C.TARGET, prediction_col: str = "prediction"):
        self.keys, self.label_col, self.prediction_col = list(keys), label_col, prediction_col

    def fit(self, df: DataFrame) -> GroupMeanModel:
        # One pass: sums and counts per group; the global mean follows from them.
        y = F.col(self.label_col)
        groups = materialize(df.groupBy(*self.keys).agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"),
                                                        F.avg(y).alias("_mean")))
        row = groups.agg(F.sum("_sum"), F.sum("_n")).first()
        g = float(row[0]) / row[1] if row[1] else 0.0
        if not self.keys:
            return GroupMeanModel([], None, True, g, self.prediction_col)
        table = groups.where(F.col("_n") > 0).na.drop(subset=self.keys).select(*self.keys, "_mean")
        return GroupMeanModel(self.keys, table, measured_bytes(table) <= DEFAULT_BROADCAST_BYTES, g, self.prediction_col)


# --- P16 / P15 / J4: case tables ---------------------------------------------
def model_prefix(name: str) -> str:
    return name.replace(" ", "_").replace("-", "_")


def case_predictions(test: DataFrame, models: dict, label_col: str = C.TARGET,
                     features: Sequence[str] | None = None) -> DataFrame:
    """Metadata, Case_Number, actual, then prediction and signed error
    (prediction - actual) for **each** model under its own prefix (defect D1
    fixed).  Models are applied one after another to the same rows, so there
    is no re-join on the key."""
    meta = [c for c in C.CASE_METADATA_COLUMNS if c in test.columns]
    extra = [c for c in (features or []) if c in test.columns and c not in meta]
    frame = test.select(*meta, *extra, F.col(label_col).alias(ACTUAL))
    out_cols = [F.col(C.KEY).cast("string").alias("Case_Number"), *[F.col(c) for c in meta], F.col(ACTUAL)]
    for name, model in models.items():
        p = model_prefix(name)
        frame = _predict(model, frame).withColumnRenamed("prediction", p + PRED_SUFFIX)
        out_cols += [F.col(p + PRED_SUFFIX),
                     S.signed_error(F.col(p + PRED_SUFFIX), F.col(ACTUAL)).alias(p + ERR_SUFFIX)]
    return frame.select(*out_cols)


def _predict(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    keep = df.columns + ["prediction"]
    return out.select(*keep)


def prediction_columns(cases: DataFrame) -> list[str]:
    """Columns ending in ``_Predicted_Minutes``."""
    return [c for c in cases.columns if c.endswith(PRED_SUFFIX)]


def long_predictions(cases: DataFrame) -> DataFrame:
    """Unpivot a wide case table to (Case_Number, model, actual, predicted)."""
    cols = prediction_columns(cases)
    return cases.unpivot(["Case_Number", ACTUAL], cols, "model_column", "predicted").select(
        "Case_Number", F.regexp_replace("model_column", PRED_SUFFIX + "$", "").alias("model"),
        F.col(ACTUAL).alias("actual"), "predicted")


def exact_medians(df: DataFrame, key: str, value: str, reach: float = 1e-3) -> DataFrame:
    """Median of ``value`` per ``key``, exact, without all values of a key in one task.

    Approximate quantiles at both sides of the middle (their error is a tenth of
    ``reach``) bracket it; the values below are only counted, and the few distinct
    values inside are ranked.
    """
    marks = materialize(df.groupBy(key).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, F.array(F.lit(0.5 - reach), F.lit(0.5 + reach)), 10000).alias("_b")))
    near = df.join(broadcast_if_small(marks), key)
    low, high = F.element_at("_b", 1), F.element_at("_b", 2)
    below = near.groupBy(key).agg(F.count_if(F.col(value) < low).alias("_below"))
    inside = near.where(F.col(value).between(low, high)).groupBy(key, value, "_n").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(key).orderBy(value))
    ranked = inside.join(below, key).withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_upto")), F.col(value)))

    middle = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2
    return ranked.groupBy(key).agg(middle.alias("median"))


def model_quality(cases: DataFrame) -> DataFrame:
    """Per model MAE, median abs error, share within 5 and 10 minutes,
    max error."""
    lp = long_predictions(cases).withColumn("err", F.abs(F.col("predicted") - F.col("actual")))
    e = F.col("err")
    plain = lp.groupBy("model").agg(
        F.avg(e).alias("mae"), F.avg((e <= 5).cast("double")).alias("within_5"),
        F.avg((e <= 10).cast("double")).alias("within_10"), F.max(e).alias("max_error"))
    medians = exact_medians(lp.where(e.isNotNull()), "model", "err")
    return (plain.join(medians, "model", "left")
                 .select("model", "mae", F.col("median").alias("median_error"), "within_5", "within_10", "max_error")
                 .orderBy("mae", "model"))


def regression_metrics(df: DataFrame, label_col: str = C.TARGET, prediction_col: str = "prediction") -> DataFrame:
    """MAE and RMSE in one pass."""
    d = F.col(prediction_col) - F.col(label_col)
    return df.agg(F.avg(F.abs(d)).alias("MAE"), F.sqrt(F.avg(d * d)).alias("RMSE"))


def comparison_table(cases: DataFrame) -> DataFrame:
    """Algorithm, MAE, RMSE for every model of a case table, ordered."""
    lp = long_predictions(cases)
    d = F.col("predicted") - F.col("actual")
    return (lp.groupBy(F.col("model").alias("Algorithm"))
              .agg(F.avg(F.abs(d)).alias("MAE"), F.sqrt(F.avg(d * d)).alias("RMSE"))
              .orderBy("MAE", "RMSE"))


def best_model(comparison: DataFrame) -> DataFrame:
    """The row with the lowest MAE, then RMSE."""
    return comparison.orderBy("MAE", "RMSE", "Algorithm").limit(1)


# --- P18 / A28–A32 / O2: residual analysis -----------------------------------
def residual_frame(df: DataFrame, label_col: str = C.TARGET, prediction_col: str = "prediction",
                   context: Sequence[str] = ()) -> DataFrame:
    """Actual, Predicted, Residual (actual - predicted), Abs_Error."""
    res = F.col(label_col) - F.col(prediction_col)
    return df.select(*context, F.col(label_col).alias("Actual"), F.col(prediction_col).alias("Predicted"),
                     res.alias("Residual"), F.abs(res).alias("Abs_Error"))


def residual_kpis(res: DataFrame, large: float = C.LARGE_ERROR_MINUTES) -> DataFrame:
    """A28 + P14: MAE, R^2 = 1 - SSE/SST, max error, count and share above ``large``."""
    big = F.col("Abs_Error") > F.lit(large)
    return res.agg(
        F.avg("Abs_Error").alias("mae"),
        (F.lit(1.0) - F.sum(F.col("Residual") * F.col("Residual"))
         / (F.count("Actual") * F.var_pop("Actual"))).alias("r2"),
        F.max("Abs_Error").alias("max_error"),
        F.count_if(big).alias("large_errors"),
        F.avg(big.cast("double")).alias("large_error_share"))


def error_by(res: DataFrame, key: str, order_by_error: bool = True) -> DataFrame:
    """Mean absolute error per key."""
    out = res.groupBy(key).agg(F.avg("Abs_Error").alias("mae"))
    return out.orderBy(F.col("mae").desc(), key) if order_by_error else out.orderBy(key)


def segmented_errors(res: DataFrame, segments: Sequence[str] = ("BOROUGH", "INCIDENT_CLASSIFICATION", "Hour", "DayOfWeek")) -> DataFrame:
    """Count, mean and max error, mean actual and predicted for every
    segment column, all in one GROUPING SETS pass; long form
    (segment, segment_value, ...)."""
    segs = [s for s in segments if s in res.columns]
    agg = res.groupingSets([[s] for s in segs], *segs).agg(
        F.count("Abs_Error").alias("cases"), F.avg("Abs_Error").alias("mean_error"),
        F.max("Abs_Error").alias("max_error"), F.avg("Actual").alias("mean_actual"),
        F.avg("Predicted").alias("mean_predicted"),
        *[F.grouping(s).alias(f"_g{i}") for i, s in enumerate(segs)])
    name = value = None
    for i, s in enumerate(segs):
        hit = F.col(f"_g{i}") == 0
        name = F.when(hit, F.lit(s)) if name is None else name.when(hit, F.lit(s))
        v = F.col(s).cast("string")
        value = F.when(hit, v) if value is None else value.when(hit, v)
    return (agg.select(name.alias("segment"), value.alias("segment_value"), "cases", "mean_error",
                       "max_error", "mean_actual", "mean_predicted")
               .orderBy("segment", F.col("mean_error").desc()))


def worst_cases(res: DataFrame, k: int = 20, key: str = C.KEY,
                context: Sequence[str] = ("BOROUGH", "INCIDENT_CLASSIFICATION", "Hour")) -> DataFrame:
    """O2: the k rows with the largest absolute error (ties by key), with context."""
    ctx = [c for c in context if c in res.columns]
    return (res.orderBy(F.col("Abs_Error").desc(), F.col(key))
               .limit(k).select(key, "Actual", "Predicted", "Residual", "Abs_Error", *ctx))


# --- P10 / P20 / M15: saved-case lookup and comparison -----------------------
def lookup_cases(df: DataFrame, ids: DataFrame, key: str = C.KEY,
                 order: Sequence[str] = (C.INCIDENT_DATETIME,)) -> DataFrame:
    """P10: rows whose key, compared as text, is in ``ids`` (column ``case_id``);
    one row per id (earliest by ``order``).  The pick is a ``min_by`` aggregate,
    which combines map-side, so a repeated id never lands in one task."""
    ids_t = ids.select(F.col("case_id").cast("string").alias("_case")).distinct()
    hits = df.withColumn("_case", F.col(key).cast("string")).join(ids_t, "_case", "left_semi")
    cols = [c for c in df.columns]
    ordering = F.struct(*[F.col(c) for c in order if c in df.columns], *[F.col(c) for c in cols])
    picked = hits.groupBy("_case").agg(F.min_by(F.struct(*cols), ordering).alias("_r"))
    return picked.select("_r.*")


def case_comparison(cases: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """P20: per requested case and model: actual, prediction and signed delta,
    with the case details."""
    if ids is not None:
        ids_t = ids.select(F.col("case_id").cast("string").alias("Case_Number")).distinct()
        cases = cases.join(ids_t, "Case_Number", "left_semi")
    details = [c for c in ["BOROUGH", "INCIDENT_CLASSIFICATION", "INCIDENT_DISPATCH_AREA",
                           "INITIAL_SEVERITY_LEVEL_CODE", "FINAL_SEVERITY_LEVEL_CODE", C.INCIDENT_DATETIME]
               if c in cases.columns]
    long = cases.unpivot(["Case_Number", ACTUAL, *details], prediction_columns(cases), "model_column", "predicted")
    return long.select(
        "Case_Number", F.regexp_replace("model_column", PRED_SUFFIX + "$", "").alias("model"),
        F.col(ACTUAL).alias("actual"), "predicted",
        (F.col("predicted") - F.col(ACTUAL)).alias("delta"), *details)


def predict_cases(df: DataFrame, ids: DataFrame, models: dict, label_col: str = C.TARGET,
                  features: Sequence[str] | None = None) -> DataFrame:
    """Score saved cases (any number of ids) with every model; prediction
    and error (prediction - actual) per case and model."""
    rows = lookup_cases(df, ids)
    return case_comparison(case_predictions(rows, models, label_col, features)).select(
        "Case_Number", "model", "actual", "predicted", F.col("delta").alias("error"))
