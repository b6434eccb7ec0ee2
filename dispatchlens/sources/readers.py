"""Readers (S1–S9) and model persistence.

Raw incident CSV is read with every column as text (dirty input; coercion is
the cleaning step's job, with ``try_cast``), so the scan never fails on junk
and stays splittable.  Existence checks go through the Hadoop file system of
the session, so they work for cluster paths as well as local ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators.clean import clean_incidents
from ..plans.ordered import first_n_by


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def _require(spark: SparkSession, path: str, what: str = "Dataset") -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")


def read_incidents_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Raw CSV with a header, all columns text; optional first ``max_rows``."""
    _require(spark, path)
    df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return df.limit(max_rows) if max_rows else df


def training_sample(raw: DataFrame, sample_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Clean the input and keep the first ``sample_rows`` clean rows.

    "First" is made deterministic (T9): ordered by incident time, then key.
    ``max_rows`` caps the raw rows read first, as the reference's ``nrows``.
    """
    if max_rows:
        raw = raw.limit(max_rows)
    clean = clean_incidents(raw)
    if sample_rows is None:
        return clean
    if clean.limit(1).count() == 0:
        raise ValueError("no row of the input is left after cleaning")
    return first_n_by(clean, sample_rows, [C.INCIDENT_DATETIME, C.KEY])


def union_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of separately read inputs, by column name; columns missing
    in one input become null (a multi-file scan does this implicitly)."""
    if not frames:
        raise ValueError("no inputs")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Columns of processed tables that are not text, by kind; all measures end as the last entry says.
_WHOLE = {C.KEY: "long", "Hour": "int", "DayOfWeek": "int", "Month": "int", "IsHeld": "int", "IsReopen": "int",
          **{c: "int" for c in C.CONTEXTUAL_FEATURES}}
_MEASURES = ("_Minutes", "_Avg", "_TargetEnc", "_sin", "_cos", "_CODE", "_QY", "MAE", "RMSE", "Importance", "R2")


def csv_schema(columns: Sequence[str]) -> str:
    """Types of a processed table's CSV columns by name, so that no pass over the data infers them
    and all files of a table get the same; unknown columns are text."""
    def kind(name: str) -> str:
        if name in (C.INCIDENT_DATETIME, C.FIRST_ON_SCENE_DATETIME):
            return "timestamp_ntz"
        return _WHOLE.get(name, "double" if name.endswith(_MEASURES) else "string")

    return ", ".join(f"`{c}` {kind(c)}" for c in columns)


def read_table_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: a processed table, Parquet or CSV with a header; ``schema`` overrides the CSV types known by name."""
    if path.endswith(".parquet") or not path.endswith(".csv"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema or csv_schema(reader.csv(path).columns)).csv(path)


def read_processed(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """S3: the first existing candidate, Parquet or CSV by suffix."""
    for path in candidates:
        if path_exists(spark, path):
            return read_table_file(spark, path)
    raise FileNotFoundError("None of the processed tables exist: " + ", ".join(candidates))


CASE_TYPES = {
    "Case_Number": "string", "CAD_INCIDENT_ID": "bigint", "INCIDENT_DATETIME": "timestamp_ntz",
    "FIRST_ON_SCENE_DATETIME": "timestamp_ntz", "BOROUGH": "string", "INCIDENT_CLASSIFICATION": "string",
    "INCIDENT_DISPATCH_AREA": "string", "INITIAL_SEVERITY_LEVEL_CODE": "double",
    "FINAL_SEVERITY_LEVEL_CODE": "double",
}


def read_case_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The wide case table (X3); model columns ``*_Minutes`` become doubles."""
    _require(spark, path, "Case predictions")
    raw = spark.read.option("header", True).csv(path)
    cols = []
    for c in raw.columns:
        t = CASE_TYPES.get(c, "double" if c.endswith("_Minutes") else "string")
        cols.append(F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c))
    return raw.select(*cols)


def read_model_comparison(spark: SparkSession, path: str) -> DataFrame:
    """Algorithm, MAE, RMSE with the two metrics rounded to 2 (half-even)."""
    _require(spark, path, "Model comparison")
    df = spark.read.option("header", True).schema("Algorithm string, MAE double, RMSE double").csv(path)
    return df.select("Algorithm", F.bround("MAE", 2).alias("MAE"), F.bround("RMSE", 2).alias("RMSE"))


def read_case_table(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned table used to score saved cases; must carry the key."""
    _require(spark, path, "Case dataset")
    df = read_table_file(spark, path)
    if C.KEY not in df.columns:
        raise ValueError(f"a case table needs the column {C.KEY}")
    return df


PAYLOAD_SCHEMA = T.StructType([
    T.StructField("payload_id", T.LongType()),
    T.StructField("Hour", T.IntegerType()), T.StructField("DayOfWeek", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("INITIAL_SEVERITY_LEVEL_CODE", T.DoubleType()),
    T.StructField("FINAL_SEVERITY_LEVEL_CODE", T.DoubleType()),
    T.StructField("BOROUGH", T.StringType()), T.StructField("INCIDENT_CLASSIFICATION", T.StringType()),
    T.StructField("INCIDENT_DISPATCH_AREA", T.StringType()),
    T.StructField("DISPATCH_RESPONSE_SECONDS_QY", T.DoubleType()), T.StructField("ZIPCODE", T.StringType()),
    T.StructField("IsHeld", T.IntegerType()), T.StructField("IsReopen", T.IntegerType()),
])


def payload_frame(spark: SparkSession, payloads: Sequence[dict]) -> DataFrame:
    """Request payloads (any number) as a typed DataFrame."""
    rows = []
    for i, p in enumerate(payloads):
        rows.append(tuple([p.get("payload_id", i)] + [p.get(f.name) for f in PAYLOAD_SCHEMA.fields[1:]]))
    return spark.createDataFrame(rows, PAYLOAD_SCHEMA)


# --- S7 / K9: model artifacts --------------------------------------------------
def save_models(models: dict, directory: str) -> list[str]:
    """K9: one artifact folder per model, named by slug (F16)."""
    from ..functions.scalars import slugify_text
    from ..operators.learning import FittedModel, StackingModel

    paths = []
    for name, m in models.items():
        base = f"{directory.rstrip('/')}/{slugify_text(name)}"
        if not isinstance(m, FittedModel):
            raise TypeError(f"cannot save {type(m).__name__}")
        m.pre.model.write().overwrite().save(f"{base}/preprocessor")
        meta = {"name": name, "numeric": m.pre.numeric, "categorical": m.pre.categorical,
                "feature_names": m.pre.feature_names}
        if isinstance(m.learner, StackingModel):
            meta["kind"] = "stacking"
            meta["bases"] = [type(b).__name__ for b in m.learner.bases]
            for i, b in enumerate(m.learner.bases):
                _save_learner(b, f"{base}/base{i}")
            m.learner.ridge.write().overwrite().save(f"{base}/ridge")
        else:
            meta["kind"] = type(m.learner).__name__
            _save_learner(m.learner, f"{base}/learner")
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{base}/meta")
        paths.append(base)
    return paths


_MODEL_CLASSES = {
    "LinearRegressionModel": "pyspark.ml.regression.LinearRegressionModel",
    "RandomForestRegressionModel": "pyspark.ml.regression.RandomForestRegressionModel",
    "BoostedModel": "dispatchlens.operators.boosting.BoostedModel",
    "ForestModel": "dispatchlens.operators.bagging.ForestModel",
}


def _save_learner(model, path: str) -> None:
    """A model of Spark ML by its own writer, boosted trees as one line of JSON."""
    if hasattr(model, "to_json"):
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)
    else:
        model.write().overwrite().save(path)


def _load_learner(spark: SparkSession, kind: str, path: str):
    import importlib

    mod, _, cls = _MODEL_CLASSES[kind].rpartition(".")
    found = getattr(importlib.import_module(mod), cls)
    return found.from_json(spark.read.text(path).first()[0]) if hasattr(found, "from_json") else found.load(path)


def load_model(spark: SparkSession, base: str):
    """Load one artifact folder written by ``save_models``."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegressionModel

    from ..operators.learning import FittedModel, Preprocessor, StackingModel

    meta = json.loads(spark.read.text(f"{base}/meta").first()[0])
    pre = Preprocessor(meta["numeric"], meta["categorical"], PipelineModel.load(f"{base}/preprocessor"),
                       meta["feature_names"])
    if meta["kind"] == "stacking":
        bases = [_load_learner(spark, k, f"{base}/base{i}") for i, k in enumerate(meta["bases"])]
        learner = StackingModel(bases, LinearRegressionModel.load(f"{base}/ridge"))
    else:
        learner = _load_learner(spark, meta["kind"], f"{base}/learner")
    return meta["name"], FittedModel(pre, learner)


def load_models(spark: SparkSession, directory: str, names: Sequence[str], required: Sequence[str] = ()) -> dict:
    """Load the named models; optional ones are skipped when absent."""
    from ..functions.scalars import slugify_text

    out = {}
    for name in names:
        base = f"{directory.rstrip('/')}/{slugify_text(name)}"
        if not path_exists(spark, f"{base}/meta"):
            if name in required:
                raise FileNotFoundError(f"model not found: {base}")
            continue
        out[name] = load_model(spark, base)[1]
    return out


def load_or_train(spark: SparkSession, directory: str, training: DataFrame,
                  names: Sequence[str] = tuple(C.MODEL_NAMES)) -> tuple[dict, str]:
    """Load saved models; where none are saved, fit all of them on all rows of
    the enhanced frame.  Any other failure to load, and any failure to fit, raises."""
    from ..operators import features as FE
    from ..operators import learning as LN

    try:
        models = load_models(spark, directory, names, required=C.MODEL_NAMES[:2])
    except FileNotFoundError:
        models = {}
    if models:
        return models, "saved"
    frame, num, cat = FE.make_enhanced_model_frame(training)
    return LN.fit_models(frame, num, cat, LN.make_models(names=list(names))), "trained"
