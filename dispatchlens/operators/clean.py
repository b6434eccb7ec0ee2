"""Cleaning and model-frame operators.

``clean_incidents`` is one lazy projection + filter over the input: it adds no
shuffle, so Catalyst pushes the null / range filters next to the scan and keeps
the whole step in one whole-stage-codegen span.  Decisions that depend on the
*schema* (which columns exist, which classification source to use) are taken on
the driver from ``df.columns``; the only data-dependent decision (T5: fall back
to a generic timestamp parse when no value of an input matches the dispatch
format) is an EXISTS subquery in the same plan that stops at the first match.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import scalars as S
from ..plans.partitioning import spread

DERIVED_COLUMNS = [C.TARGET, "Hour", "DayOfWeek", "Month", "IsHeld", "IsReopen"]


def column_label(raw: str) -> str:
    """A column's working name: no white space around it, blanks and hyphens joined, capitals."""
    return re.sub("[ -]", "_", str(raw).strip()).upper()


def with_working_names(df: DataFrame) -> DataFrame:
    """All columns under their working names; two columns of one name raise."""
    by_label: dict[str, list[str]] = {}
    for raw in df.columns:
        by_label.setdefault(column_label(raw), []).append(raw)
    clash = {label: raws for label, raws in by_label.items() if len(raws) > 1}
    if clash:
        raise ValueError(f"several columns share a working name: {clash}")
    return df.toDF(*by_label)


def classification_source(columns: Sequence[str]) -> str | None:
    """The column that classifies incidents: the first known one that is there."""
    return next((c for c in C.CLASSIFICATION_SOURCE_COLUMNS if c in columns), None)


def with_classification(df: DataFrame) -> DataFrame:
    """The table with its classification column, or an error that lists what is not there."""
    source = classification_source(df.columns)
    absent = sorted(set(C.REQUIRED_COLUMNS) - set(df.columns))
    if source is None:
        absent.append(f"one of {C.CLASSIFICATION_SOURCE_COLUMNS}")
    if absent:
        raise ValueError(f"the table lacks {absent}; it has {df.columns}")
    target = C.CLASSIFICATION_SOURCE_COLUMNS[0]
    return df if source == target else df.withColumn(target, F.col(source))


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def _is_time(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def datetime_probes(df: DataFrame, names: list[str], fallback: str = "probe") -> DataFrame:
    """T5 probes for text datetime columns, added as boolean columns ``_fmt_<name>``.

    Each probe is an uncorrelated EXISTS subquery in the same plan: it stops at
    the first row that parses with the dispatch format and shares the input's
    exchanges with the main query (no extra driver job, no second input pass).
    """
    if fallback != "probe":
        return df
    probes = [df.where(S.parse_text_datetime(n).isNotNull()).exists().alias(f"_fmt_{n}")
              for n in names if not _is_time(_dtype(df, n))]
    return df.select("*", *probes) if probes else df


def datetime_column(df: DataFrame, name: str, fallback: str = "probe") -> Column:
    """F1 for one column.

    Text is parsed with the dispatch format.  ``fallback`` decides when the
    generic parse is used instead: ``"probe"`` (reference rule: only if no value
    of this input parses; needs the ``_fmt_<name>`` column from
    ``datetime_probes``), ``"never"`` or ``"always"``.
    """
    dt = _dtype(df, name)
    if _is_time(dt):
        return F.col(name).cast("timestamp_ntz")
    parsed = S.parse_text_datetime(name)
    if fallback == "never":
        return parsed
    generic = S.parse_generic_datetime(name)
    if fallback == "always":
        return generic
    return F.when(F.col(f"_fmt_{name}"), parsed).otherwise(generic)


def response_minutes(df: DataFrame, t0: Column, t1: Column) -> Column:
    """reported seconds / 60 where valid, else the timestamp difference."""
    stamp_minutes = S.minutes_between(t0, t1)
    if "INCIDENT_RESPONSE_SECONDS_QY" not in df.columns:
        return stamp_minutes
    reported = S.to_number("INCIDENT_RESPONSE_SECONDS_QY") / F.lit(60.0)
    if "VALID_INCIDENT_RSPNS_TIME_INDC" in df.columns:
        valid = F.upper(F.col("VALID_INCIDENT_RSPNS_TIME_INDC").cast("string")) == F.lit("Y")
        reported = F.when(valid, reported)
    return F.coalesce(reported, stamp_minutes)


def clean_incidents(df: DataFrame, datetime_fallback: str = "probe") -> DataFrame:
    """The whole cleaning step as one lazy plan.

    Output columns: the input columns (normalised names, cleaned in place), then
    INCIDENT_CLASSIFICATION when derived, Response_Time_Minutes, Hour,
    DayOfWeek, Month, IsHeld, IsReopen.
    """
    if df.isStreaming and datetime_fallback == "probe":
        # A stream cannot be probed (subqueries over streams are not allowed):
        # use the dispatch format as is.
        datetime_fallback = "never"
    df = with_working_names(df)
    # A re-cleaned table carries upper-cased copies of derived columns;
    # Spark resolves names case-insensitively, so drop them before deriving.
    derived_upper = {c.upper() for c in DERIVED_COLUMNS}
    df = df.drop(*[c for c in df.columns if c in derived_upper])
    df = with_classification(df)

    stamps = [C.INCIDENT_DATETIME, C.FIRST_ON_SCENE_DATETIME]
    source_cols = df.columns
    df = datetime_probes(df, stamps, datetime_fallback)
    if any(not _is_time(_dtype(df, n)) for n in stamps):
        # Text stamps make the parse below the costly part: spread a
        # single-split input over tasks first (after the probes, which then
        # stop at the first matching row of the raw scan).
        df = spread(df)
    t0, t1 = [datetime_column(df, n, datetime_fallback) for n in stamps]
    # The parsed stamps are produced by a one-row generator:
    # Catalyst cannot push the row filter below a Generate for predicates on
    # its output, so each stamp is parsed once, after the scan has been spread
    # over tasks, instead of being inlined into a pushed-down filter and then
    # parsed again in the projection.
    derived = F.inline(F.array(F.struct(t0.alias("_t0"), t1.alias("_t1"))))
    rest = [c for c in source_cols if c not in stamps]
    staged = df.select(*rest, derived)
    staged = staged.withColumn("_y", response_minutes(df, F.col("_t0"), F.col("_t1")))
    kept = staged.where(
        F.col("_t0").isNotNull()
        & F.col("_t1").isNotNull()
        & F.col("BOROUGH").isNotNull()
        & F.col("_y").isNotNull()
        & F.col("_y").between(F.lit(C.RESPONSE_TIME_MIN), F.lit(C.RESPONSE_TIME_MAX))
    )
    order = [F.col("_t0").alias(c) if c == C.INCIDENT_DATETIME
             else F.col("_t1").alias(c) if c == C.FIRST_ON_SCENE_DATETIME else F.col(c) for c in source_cols]
    kept = kept.select(*order, F.col("_y").alias(C.TARGET))

    text_cols = set(C.BASE_CATEGORICAL_FEATURES + C.OPTIONAL_FEATURE_COLUMNS)
    numeric_cols = set(C.NUMERIC_FEATURES)
    out: list[Column] = []
    for name in kept.columns:
        if name == "DISPATCH_RESPONSE_SECONDS_QY":
            out.append(S.dispatch_seconds(name).alias(name))
        elif name in text_cols:
            out.append(S.as_text(name).alias(name))
        elif name in numeric_cols and not is_numeric_type(_dtype(kept, name)):
            out.append(S.to_number(name).alias(name))
        else:
            out.append(F.col(name))
    ts = F.col(C.INCIDENT_DATETIME)
    out += [
        S.hour_of(ts).alias("Hour"),
        S.weekday_of(ts).alias("DayOfWeek"),
        S.month_of(ts).alias("Month"),
        (S.yes_flag("HELD_INDICATOR") if "HELD_INDICATOR" in kept.columns else F.lit(0)).alias("IsHeld"),
        (S.yes_flag("REOPEN_INDICATOR") if "REOPEN_INDICATOR" in kept.columns else F.lit(0)).alias("IsReopen"),
    ]
    return kept.select(*out)


# --- P7 / P8 / A5: feature lists and model frames --------------------------
def present(df: DataFrame, *wanted: Sequence[str]) -> list[str]:
    """The wanted columns that the table has, in the order they are wanted."""
    have = set(df.columns)
    return [c for group in wanted for c in group if c in have]


def feature_columns(df: DataFrame, numeric: Sequence[str] = tuple(C.NUMERIC_FEATURES)) -> tuple[list[str], list[str]]:
    """Usable numeric and categorical features of a table."""
    return present(df, numeric), present(df, C.BASE_CATEGORICAL_FEATURES, C.OPTIONAL_FEATURE_COLUMNS)


def split_column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """A5: numeric versus other columns (timestamps count as 'other')."""
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    other = [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]
    return numeric, other


def model_frame(df: DataFrame, numeric: list[str], categorical: list[str],
                keep: list[str] | None = None) -> DataFrame:
    """Project key columns + features + target and drop rows with any null.

    ``keep`` columns (e.g. the incident key) are carried but not null-checked.
    """
    keep = [c for c in (keep or []) if c in df.columns and c not in numeric + categorical]
    features = numeric + categorical + [C.TARGET]
    return df.select(*keep, *features).na.drop(subset=features)


def make_model_frame(df: DataFrame, keep: list[str] | None = (C.KEY,)) -> tuple[DataFrame, list[str], list[str]]:
    numeric, categorical = feature_columns(df)
    return model_frame(df, numeric, categorical, list(keep or [])), numeric, categorical
