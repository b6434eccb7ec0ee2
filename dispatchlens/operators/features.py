"""Feature operators: cyclical / contextual columns (F8, F9), smoothed target
encoding (A8), group-average features (A9), the lookup build (A10), lookup
joins (J1–J3) and the enhanced model frame (P9).

All six lookup tables and the global mean come from **one** GROUPING SETS
aggregation over the source table (one scan, partial aggregation, a tiny
shuffle).  The result is materialized once in the checkpoint folder, its size
is counted per lookup, and each lookup is joined back with a broadcast only
when that count is under the limit (``plans.joins``).  This replaces pandas'
``groupby().transform('mean')``, which as a window would shuffle every row by
a heavily skewed key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from .clean import feature_columns
from ..plans.joins import DEFAULT_BROADCAST_BYTES, materialize, measured_bytes

# (feature name, key columns, smoothed?)  Order of the lookup sets.
LOOKUP_SPECS = [
    ("Borough_Hour_Avg", ["BOROUGH", "Hour"], False),
    ("Classification_Severity_Avg", ["INCIDENT_CLASSIFICATION", "INITIAL_SEVERITY_LEVEL_CODE"], False),
    ("DispatchArea_Hour_Avg", ["INCIDENT_DISPATCH_AREA", "Hour"], False),
    ("Classification_TargetEnc", ["INCIDENT_CLASSIFICATION"], True),
    ("DispatchArea_TargetEnc", ["INCIDENT_DISPATCH_AREA"], True),
    ("Borough_TargetEnc", ["BOROUGH"], True),
]


# Every calendar feature: its name, the column it needs, its expression.
# Periods and first values of the three calendar columns.
_CYCLES = (("Hour", 24, 0), ("DayOfWeek", 7, 0), ("Month", 12, 1))
CYCLE_FEATURES = [(f"{column}_{wave}", column, lambda c, n=period, z=first, k=k: S.cyclical(c, n, z)[k])
                  for column, period, first in _CYCLES for k, wave in enumerate(("sin", "cos"))]
FLAG_FEATURES = [("IsWeekend", "DayOfWeek", S.is_weekend), ("IsNight", "Hour", S.is_night), ("IsRushHour", "Hour", S.is_rush_hour)]


def with_calendar_features(df: DataFrame, features=(*CYCLE_FEATURES, *FLAG_FEATURES)) -> DataFrame:
    """Sine and cosine of hour, weekday and month, and the weekend, night and rush-hour flags,
    as far as the table has their columns."""
    made = {name: make(column) for name, column, make in features if column in df.columns}
    return df.withColumns(made) if made else df


@dataclass
class Lookups:
    """Fitted lookup tables (A10) plus the global mean of the source table."""

    global_mean: float
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    small: bool = False
    long_form: DataFrame | None = None

    def join(self, df: DataFrame, name: str, fallback: bool) -> DataFrame:
        """Left-join one lookup; a miss gives the global mean when ``fallback``."""
        table = F.broadcast(self.tables[name]) if self.small else self.tables[name]
        out = df.join(table, self.keys[name], "left")
        if fallback:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(self.global_mean)))
        return out


def fit_lookups(source: DataFrame, smoothing: int = C.TARGET_SMOOTHING) -> Lookups:
    """A10: global mean + six lookups in one GROUPING SETS pass over ``source``.

    Lookups whose key columns are absent are skipped.  Group keys that are null
    are left out (pandas ``groupby`` drops them).
    """
    specs = [s for s in LOOKUP_SPECS if all(k in source.columns for k in s[1])]
    if C.TARGET not in source.columns:
        return Lookups(global_mean=0.0)
    key_cols = []
    for _, keys, _ in specs:
        for k in keys:
            if k not in key_cols:
                key_cols.append(k)
    sets = [list(keys) for _, keys, _ in specs] + [[]]
    t = F.col(C.TARGET)
    agg = (source.groupingSets(sets, *key_cols)
                 .agg(F.avg(t).alias("mean"), F.count(t).alias("n"),
                      F.grouping_id(*key_cols).alias("gid")))
    agg = materialize(agg)
    n_keys = len(key_cols)
    all_bits = (1 << n_keys) - 1
    gids = {}
    for name, keys, _ in specs:
        present = 0
        for k in keys:
            present |= 1 << (n_keys - 1 - key_cols.index(k))
        gids[name] = all_bits ^ present
    grand = agg.where(F.col("gid") == all_bits).select("mean").collect()
    g = float(grand[0]["mean"]) if grand and grand[0]["mean"] is not None else 0.0

    out = Lookups(global_mean=g, small=measured_bytes(agg) <= DEFAULT_BROADCAST_BYTES)
    longs = []
    for name, keys, smoothed in specs:
        part = agg.where(F.col("gid") == gids[name])
        for k in keys:
            part = part.where(F.col(k).isNotNull())
        if smoothed:
            value = ((F.col("n") * F.col("mean") + F.lit(float(smoothing)) * F.lit(g))
                     / (F.col("n") + F.lit(float(smoothing))))
        else:
            value = F.col("mean")
        out.tables[name] = part.select(*keys, value.alias(name))
        out.keys[name] = list(keys)
        k2 = F.col(keys[1]).cast("double") if len(keys) > 1 else F.lit(None).cast("double")
        longs.append(part.select(F.lit(name).alias("lookup"), F.col(keys[0]).cast("string").alias("key1"),
                                 k2.alias("key2"), value.alias("value")))
    spark = source.sparkSession
    longs.append(spark.range(1).select(F.lit("_global_mean").alias("lookup"), F.lit(None).cast("string").alias("key1"),
                                       F.lit(None).cast("double").alias("key2"), F.lit(g).alias("value")))
    long_df = longs[0]
    for x in longs[1:]:
        long_df = long_df.unionByName(x)
    out.long_form = long_df
    return out


def add_target_encoding(df: DataFrame, lookups: Lookups | None = None,
                        smoothing: int = C.TARGET_SMOOTHING) -> DataFrame:
    """``(n * mean + s * g) / (n + s)`` per classification, area and borough;
    unseen keys get the global mean.  Without ``lookups`` the statistics come
    from ``df`` itself (the reference behaviour, T15)."""
    lookups = lookups or fit_lookups(df, smoothing)
    for name in ["Classification_TargetEnc", "DispatchArea_TargetEnc", "Borough_TargetEnc"]:
        if name in lookups.tables:
            df = lookups.join(df, name, fallback=True)
    return df


def add_interaction_features(df: DataFrame, lookups: Lookups | None = None) -> DataFrame:
    """Group means of borough x hour, classification x severity and
    area x hour attached to each row (null when the row's key is null)."""
    lookups = lookups or fit_lookups(df)
    for name in ["Borough_Hour_Avg", "Classification_Severity_Avg", "DispatchArea_Hour_Avg"]:
        if name in lookups.tables:
            df = lookups.join(df, name, fallback=False)
    return df


def enhance(df: DataFrame, lookups: Lookups | None = None) -> DataFrame:
    """F8 + F9 + A8 + A9 in the reference's order."""
    lookups = lookups or fit_lookups(df)
    out = with_calendar_features(df)
    out = add_target_encoding(out, lookups)
    return add_interaction_features(out, lookups)


def make_enhanced_model_frame(df: DataFrame, lookups: Lookups | None = None,
                              keep: tuple[str, ...] = (C.KEY,)) -> tuple[DataFrame, list[str], list[str]]:
    """Enhanced features, projected with the target, rows with nulls dropped."""
    enhanced = enhance(df, lookups)
    numeric, categorical = feature_columns(enhanced, C.ENHANCED_NUMERIC_FEATURES)
    features = numeric + categorical + [C.TARGET]
    kept = [c for c in keep if c in enhanced.columns and c not in features]
    return enhanced.select(*kept, *features).na.drop(subset=features), numeric, categorical


def prediction_input(payload: DataFrame, lookups: Lookups, feature_names: list[str],
                     categorical: list[str]) -> DataFrame:
    """Turn payload rows (any number) into model input rows.

    Derive F8/F9, attach all six lookups with the global mean for any miss, add
    missing features as 0, coerce categoricals to trimmed text ('' for null)
    and numerics to numbers (0 for null), and project in feature order.  Extra
    payload columns (e.g. an id) listed before the features are kept.
    """
    frame = with_calendar_features(payload)
    for name in lookups.tables:
        frame = lookups.join(frame, name, fallback=True)
    passthrough = [c for c in payload.columns if c not in feature_names]
    cols = [F.col(c) for c in passthrough]
    for c in feature_names:
        present = c in frame.columns
        if c in categorical:
            v = S.trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))) if present else F.lit("0.0")
        else:
            v = F.coalesce(S.to_number(F.col(c)), F.lit(0.0)) if present else F.lit(0.0)
        cols.append(v.alias(c))
    return frame.select(*cols)
