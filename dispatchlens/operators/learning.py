"""Learning operators on Spark ML.

* Preprocessing (M1–M3, T10): numerics are assembled and standardised (mean 0;
  Spark scales by the sample std), categoricals are indexed alphabetically
  with unseen values kept at an extra index, one-hot encoded and sliced so
  that the alphabetically first level *and* unseen values both give all-zero
  columns.  The indexers are fitted first (one pass for all columns) because
  the slice depends on the number of levels.
* Training works on one persisted, already-vectorised training frame shared by
  all learners, so cleaning and encoding are not recomputed per model.
* Stacking (M8) is an estimator of its own: deterministic 3-fold ids from the
  incident key, out-of-fold base predictions (union of three fold scorings), a
  ridge meta-learner with sklearn's scaling (T11), base models refit on all
  training rows.  The boosted bases of all folds grow in the same jobs.
"""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler,
                                VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from .bagging import Forest
from .boosting import FEATURES, BoostConfig, Boosted, fit_together


# --- M1–M3 / M17: preprocessing ---------------------------------------------
@dataclass
class Preprocessor:
    numeric: list[str]
    categorical: list[str]
    model: PipelineModel | None = None
    feature_names: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "Preprocessor":
        stages = []
        names: list[str] = []
        parts: list[str] = []
        if self.numeric:
            num_vec = VectorAssembler(inputCols=self.numeric, outputCol="_num_raw", handleInvalid="keep")
            raw = num_vec.transform(df.select(*self.numeric))
            scaler = StandardScaler(inputCol="_num_raw", outputCol="_num", withMean=True, withStd=True).fit(raw)
            stages += [num_vec, scaler]
            parts.append("_num")
            names += list(self.numeric)
        if self.categorical:
            idx_cols = [f"_{c}_idx" for c in self.categorical]
            indexer = StringIndexer(inputCols=self.categorical, outputCols=idx_cols,
                                    stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
            oh_cols = [f"_{c}_oh" for c in self.categorical]
            encoder = OneHotEncoder(inputCols=idx_cols, outputCols=oh_cols, dropLast=False,
                                    handleInvalid="keep").fit(indexer.transform(df.limit(0)))
            stages += [indexer, encoder]
            for c, oh, labels in zip(self.categorical, oh_cols, indexer.labelsArray):
                keep = list(range(1, len(labels)))  # drop the first level and the unseen slot
                if not keep:
                    continue
                stages.append(VectorSlicer(inputCol=oh, outputCol=f"{oh}_s", indices=keep))
                parts.append(f"{oh}_s")
                names += [f"{c}_{labels[i]}" for i in keep]
        stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
        self.model = PipelineModel(stages)
        self.feature_names = names
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


# --- M4–M7: learners ----------------------------------------------------------
# Learner settings of the five compared models.
FOREST_TREES = 100
FOREST_DEPTH = 12
BOOST_A = BoostConfig(max_iter=300, max_depth=8, step_size=0.05, subsampling_rate=0.8, column_rate=0.8, l2=1.0)
# Leaf by leaf; rows are not drawn (their rate has no effect there without a bagging frequency).
BOOST_B = BoostConfig(max_iter=300, max_depth=8, step_size=0.05, column_rate=0.8, l2=0.0, leaves=31, min_rows=20, max_bins=255)
# Base learners inside the stack use no row / column subsampling.
STACK_BOOST_A = replace(BOOST_A, subsampling_rate=1.0, column_rate=1.0)
STACK_BOOST_B = replace(BOOST_B, column_rate=1.0)
RIDGE_ALPHA = 1.0
STACK_FOLDS = 3


def linear(label: str = C.TARGET) -> LinearRegression:
    return LinearRegression(featuresCol=FEATURES, labelCol=label, regParam=0.0, elasticNetParam=0.0,
                            solver="auto")


def forest(label: str = C.TARGET, seed: int = C.SEED, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> Forest:
    return Forest(featuresCol=FEATURES, labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed)


def boosted(cfg: BoostConfig, label: str = C.TARGET, seed: int = C.SEED) -> Boosted:
    return Boosted(cfg, label, seed)


def parallel_map(fn, items: list, parallelism: int) -> list:
    """Run independent Spark fits from a small thread pool (jobs run concurrently)."""
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


# --- M8: stacking -------------------------------------------------------------
class StackingModel:
    def __init__(self, bases: list, ridge):
        self.bases, self.ridge = bases, ridge

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.bases):
            out = m.transform(out).withColumnRenamed("prediction", f"_base{i}")
        meta = VectorAssembler(inputCols=[f"_base{i}" for i in range(len(self.bases))], outputCol="_meta")
        out = self.ridge.transform(meta.transform(out))
        return out.drop("_meta", *[f"_base{i}" for i in range(len(self.bases))])


class StackingRegressor:
    """Out-of-fold stacking of base learners with a ridge meta-learner."""

    def __init__(self, bases: list, alpha: float = RIDGE_ALPHA, folds: int = STACK_FOLDS,
                 key: str = C.KEY, label: str = C.TARGET, seed: int = C.SEED, parallelism: int = 8):
        self.bases, self.alpha, self.folds = bases, alpha, folds
        self.key, self.label, self.seed, self.parallelism = key, label, seed, parallelism

    def fit(self, df: DataFrame) -> StackingModel:
        fold = F.pmod(S.key_hash(self.key, self.seed + 1), F.lit(self.folds))
        data = df.withColumn("_fold", fold).persist(StorageLevel.MEMORY_AND_DISK)
        # All fold fits and the refits on all rows are independent.  Boosted bases share one binned
        # table and their jobs; the others are fitted meanwhile.
        together = [i for i, b in enumerate(self.bases) if isinstance(b, Boosted)]
        parts = [*range(self.folds), None]
        jobs = [(f, i) for f in parts for i in range(len(self.bases)) if i not in together]

        def run(job):
            if job is None:
                models = fit_together(data, [(self.bases[i].config, f) for f in parts for i in together], self.label, self.seed,
                                      self.key, "_fold")
                return dict(zip([(f, i) for f in parts for i in together], models))
            f, i = job
            return {job: self.bases[i].copy().fit(data if f is None else data.where(F.col("_fold") != f))}

        fitted = {}
        for some in parallel_map(run, [None] * bool(together) + jobs, self.parallelism):
            fitted.update(some)
        oof = None
        for f in range(self.folds):
            scored = data.where(F.col("_fold") == f).select(self.key, self.label, FEATURES)
            for i in range(len(self.bases)):
                scored = fitted[(f, i)].transform(scored).withColumnRenamed("prediction", f"_base{i}")
            oof = scored if oof is None else oof.unionByName(scored)
        meta = VectorAssembler(inputCols=[f"_base{i}" for i in range(len(self.bases))], outputCol="_meta")
        oof = meta.transform(oof).persist(StorageLevel.MEMORY_AND_DISK)
        stats = oof.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(self.label).alias("s")).first()
        n, s = int(stats["n"]), float(stats["s"] or 0.0)
        # sklearn's ridge penalty alpha*||w||^2 on the summed loss equals
        # Spark's regParam = alpha / n * std(label) with unstandardised features.
        reg = self.alpha / n * s if n else 0.0
        ridge = LinearRegression(featuresCol="_meta", labelCol=self.label, regParam=reg, elasticNetParam=0.0,
                                 standardization=False, solver="normal").fit(oof)
        finals = [fitted[(None, i)] for i in range(len(self.bases))]
        oof.unpersist()
        data.unpersist()
        return StackingModel(finals, ridge)


def stacking(label: str = C.TARGET, seed: int = C.SEED) -> StackingRegressor:
    return StackingRegressor([forest(label, seed), boosted(STACK_BOOST_A, label, seed),
                              boosted(STACK_BOOST_B, label, seed)], label=label, seed=seed)


def make_models(label: str = C.TARGET, seed: int = C.SEED, names: list[str] | None = None) -> dict:
    """The five compared learners, by name (M4–M8)."""
    all_models = {
        C.MODEL_NAMES[0]: linear(label),
        C.MODEL_NAMES[1]: forest(label, seed),
        C.MODEL_NAMES[2]: boosted(BOOST_A, label, seed),
        C.MODEL_NAMES[3]: boosted(BOOST_B, label, seed),
        C.MODEL_NAMES[4]: stacking(label, seed),
    }
    return {n: m for n, m in all_models.items() if names is None or n in names}


# --- M9 / M13: train, score, compare ------------------------------------------
class FittedModel:
    """Preprocessor + learner: ``transform`` takes raw feature columns."""

    def __init__(self, pre: Preprocessor, learner):
        self.pre, self.learner = pre, learner

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.learner.transform(self.pre.transform(df))
        drop = [c for c in out.columns if c.startswith("_") and c not in df.columns] + [FEATURES]
        return out.drop(*[c for c in drop if c in out.columns])


# Rows in a partition of the training frame, and partitions at least.
LAYOUT_ROWS, LAYOUT_PARTITIONS = 200_000, 4


def laid_out(df: DataFrame, key: str, rows: int, per_partition: int = LAYOUT_ROWS, least: int = LAYOUT_PARTITIONS) -> DataFrame:
    """``df`` in an order and partitioning that depend on its rows only, not on cores or files.

    Tree learners draw their samples by partition, so their models do too.
    """
    n = max(least, -(-rows // per_partition))
    if key not in df.columns:
        return df.repartition(n)
    return df.repartition(n, key).sortWithinPartitions(key)


def fit_models(train: DataFrame, numeric: list[str], categorical: list[str],
               models: dict | None = None, label: str = C.TARGET, key: str = C.KEY,
               parallelism: int = 4) -> dict[str, FittedModel]:
    """Fit every learner on one shared, persisted, vectorised training frame.

    The raw frame is persisted as well while the preprocessing is fitted and the
    rows are counted, so cleaning runs once."""
    models = models if models is not None else make_models(label)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    pre = Preprocessor(numeric, categorical).fit(train)
    cols = [c for c in [key] if c in train.columns]
    prepared = laid_out(pre.transform(train).select(*cols, FEATURES, label), key, train.count())
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    names = list(models)
    try:
        learners = parallel_map(lambda n: models[n].fit(prepared), names, parallelism)
    finally:
        prepared.unpersist()
        train.unpersist()
    return {n: FittedModel(pre, m) for n, m in zip(names, learners)}


# --- M11 / M12: random search with k-fold CV -----------------------------------
# Search spaces of the two tuning routines.
FOREST_SPACE = {"numTrees": [100, 200, 300, 500], "maxDepth": [8, 12, 16, 20],
                "minInstancesPerNode": [1, 2, 4]}
BOOST_SPACE = {"max_iter": [200, 300, 500, 800], "max_depth": [4, 6, 8, 10], "step_size": [0.01, 0.03, 0.05, 0.1],
               "subsampling_rate": [0.7, 0.8, 0.9], "column_rate": [0.7, 0.8, 0.9]}


def sample_draws(space: dict, draws: int = 20, seed: int = C.SEED) -> list[dict]:
    """Draw ``draws`` random parameter combinations (without repeats)."""
    rng = random.Random(seed)
    keys = sorted(space)
    combos, seen = [], set()
    total = 1
    for k in keys:
        total *= len(space[k])
    while len(combos) < min(draws, total):
        pick = tuple(rng.choice(space[k]) for k in keys)
        if pick not in seen:
            seen.add(pick)
            combos.append(dict(zip(keys, pick)))
    return combos


def sample_param_maps(estimator, space: dict, draws: int = 20, seed: int = C.SEED) -> list:
    """``sample_draws`` as parameter maps of an estimator of Spark ML."""
    return [{estimator.getParam(k): v for k, v in d.items()} for d in sample_draws(space, draws, seed)]


def random_search(estimator, space: dict, prepared: DataFrame, draws: int = 20, folds: int = 3,
                  label: str = C.TARGET, seed: int = C.SEED, parallelism: int = 4):
    """Sampled parameter maps evaluated by k-fold CV on MAE; returns the best model."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    maps = sample_param_maps(estimator, space, draws, seed)
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mae")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, numFolds=folds,
                        seed=seed, parallelism=parallelism)
    return cv.fit(prepared)


def tune_random_forest(prepared: DataFrame, draws: int = 20, folds: int = 3, label: str = C.TARGET,
                       seed: int = C.SEED, parallelism: int = 4):
    """Random search over the forest space, 3-fold CV on MAE; best model."""
    return random_search(forest(label, seed), FOREST_SPACE, prepared, draws, folds, label, seed,
                         parallelism).bestModel


def search_boosted(prepared: DataFrame, draws: int = 20, folds: int = 3, label: str = C.TARGET, seed: int = C.SEED,
                   key: str = C.KEY, space: dict | None = None) -> tuple[DataFrame, object]:
    """Random search over the boosted-tree space, k-fold CV on MAE.

    The models of all draws and folds grow in the same jobs over one binned table, and
    one pass scores each row with the models that left out its fold.  Returns the table
    (draw, parameters, mean_mae, chosen) and the chosen draw's model, fitted on all rows.
    """
    configs = [BoostConfig(**d) for d in sample_draws(space or BOOST_SPACE, draws, seed)]
    data = prepared.withColumn("_fold", F.pmod(S.key_hash(key, seed + 1), F.lit(folds)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = fit_together(data, [(c, f) for c in configs for f in range(folds)], label, seed, key, "_fold")
        x = vector_to_array(F.col(FEATURES))
        errors = [F.avg(F.when(F.col("_fold") == f, F.abs(models[d * folds + f].scored(x) - F.col(label)))).alias(f"e{d}_{f}")
                  for d in range(len(configs)) for f in range(folds)]
        found = data.agg(*errors).first()
        mean = [sum(found[f"e{d}_{f}"] for f in range(folds)) / folds for d in range(len(configs))]
        best = min(range(len(mean)), key=lambda d: (mean[d], d))
        final = fit_together(data, [(configs[best], None)], label, seed, key)[0]
    finally:
        data.unpersist()
    keys = sorted(space or BOOST_SPACE)
    rows = [(d, json.dumps({k: asdict(c)[k] for k in keys}), mean[d], d == best) for d, c in enumerate(configs)]
    table = prepared.sparkSession.createDataFrame(rows, "draw int, parameters string, mean_mae double, chosen boolean")
    return table, final


def tune_boosted(prepared: DataFrame, draws: int = 20, folds: int = 3, label: str = C.TARGET, seed: int = C.SEED,
                 key: str = C.KEY):
    """The best model of ``search_boosted``."""
    return search_boosted(prepared, draws, folds, label, seed, key)[1]


# --- M16 / M17: importance -----------------------------------------------------
def feature_importance(model: FittedModel, top_n: int = 20) -> DataFrame:
    """Named tree importances, highest first (empty for non-tree learners)."""
    learner = model.learner
    names = model.pre.feature_names
    from pyspark.sql import SparkSession
    ss = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if not hasattr(learner, "featureImportances"):
        return ss.createDataFrame([], "Feature string, Importance double")
    imp = learner.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda r: (-r[1], r[0]))[:top_n]
    return ss.createDataFrame(rows, "Feature string, Importance double")


# --- M20 / A27: clustering -----------------------------------------------------
CLUSTER_FEATURES = ["Hour", "DayOfWeek", "Month", "INITIAL_SEVERITY_LEVEL_CODE"]


def cluster_profile(df: DataFrame, k: int = 5, seed: int = C.SEED, min_rows: int = 100) -> DataFrame:
    """M20 + A27: k-means on standardised calendar, severity and target columns
    (all rows, no sample), then per cluster mean target, count, mean hour and
    mean severity."""
    if not 3 <= k <= 8:
        raise ValueError("k must be between 3 and 8")
    feats = [c for c in CLUSTER_FEATURES if c in df.columns]
    data = df.select(*feats, C.TARGET).na.drop()
    if data.limit(min_rows + 1).count() <= min_rows:
        raise ValueError(f"clustering needs more than {min_rows} rows")
    vec = VectorAssembler(inputCols=feats + [C.TARGET], outputCol="_raw").transform(data)
    scaled = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    scaled = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    km = KMeans(featuresCol="_z", predictionCol="cluster", k=k, seed=seed).fit(scaled)
    # The few cluster rows are read before the cache is freed.
    out = km.transform(scaled)
    aggs = [F.avg(C.TARGET).alias("mean_minutes"), F.count(C.TARGET).alias("cases"),
            F.avg("Hour").alias("mean_hour")]
    if "INITIAL_SEVERITY_LEVEL_CODE" in feats:
        aggs.append(F.avg("INITIAL_SEVERITY_LEVEL_CODE").alias("mean_severity"))
    profile = out.groupBy("cluster").agg(*aggs).orderBy("cluster")
    rows = profile.collect()
    scaled.unpersist()
    return df.sparkSession.createDataFrame(rows, profile.schema)


# --- M14 / A44: scoring payloads ------------------------------------------------
def score_payloads(inputs: DataFrame, models: dict[str, FittedModel], key: str = "payload_id") -> DataFrame:
    """Every model's prediction for every payload row, long form
    (payload_id, model, predicted_minutes), ordered by prediction per payload."""
    out = None
    for name, m in models.items():
        p = m.transform(inputs).select(key, F.lit(name).alias("model"),
                                       F.col("prediction").alias("predicted_minutes"))
        out = p if out is None else out.unionByName(p)
    return out.orderBy(key, "predicted_minutes")


# --- R9: importance per segment ------------------------------------------------
def segment_importance(df: DataFrame, numeric: list[str], categorical: list[str], segment: str = "BOROUGH",
                       estimator=None, top_n: int = 20, parallelism: int = 4) -> DataFrame:
    """Fit one tree learner per segment value and report its named
    importances (segment, Feature, Importance).  The segment list is read with
    one small distinct aggregate; fits run concurrently."""
    values = [r[0] for r in df.select(segment).distinct().orderBy(segment).collect()]
    est = estimator if estimator is not None else forest()

    def run(v):
        part = df.where(F.col(segment) == F.lit(v))
        fitted = fit_models(part, numeric, [c for c in categorical if c != segment], {"m": est.copy()},
                            parallelism=1)["m"]
        return feature_importance(fitted, top_n).select(F.lit(v).alias(segment), "Feature", "Importance")

    parts = parallel_map(run, values, parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
