"""Table profile operators (A1–A5).

* duplicates (A2) are found hash-first: rows are grouped by a 64-bit hash of all
  columns (8 bytes shuffled per row, partial aggregation collapses hot copies
  map-side); only rows whose hash repeats are compared in full;
* missing counts (A3) are one aggregation pass with one ``count_if`` per column,
  then unpivoted to long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import broadcast_if_small, materialize
from .clean import split_column_kinds


def _missing(df: DataFrame, name: str):
    c = F.col(name)
    dt = df.schema[name].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def duplicate_count(df: DataFrame) -> DataFrame:
    """A2: number of rows that repeat an earlier row (nulls compare equal)."""
    cols = df.columns
    h = F.xxhash64(*[F.col(c) for c in cols]).alias("_h")
    hashed = df.select(h, *cols)
    repeated = (hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > 1).select("_h"))
    repeated = materialize(repeated)
    candidates = hashed.join(broadcast_if_small(repeated), "_h", "left_semi")
    groups = candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """A3: (column_name, missing) for every column, one aggregation pass."""
    wide = df.agg(*[F.count_if(_missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column_name, missing)")


def missing_ratio_top(df: DataFrame, k: int = 8) -> DataFrame:
    """A4: share of missing values per column, highest first, top k."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return (missing_counts(df)
            .select("column_name", (F.col("missing") / rows).alias("missing_ratio"))
            .orderBy(F.col("missing_ratio").desc(), "column_name").limit(k))


def profile(df: DataFrame, selected_features: list[str]) -> DataFrame:
    """A1: one row with row and column counts, duplicates, and the numeric,
    non-numeric and selected column lists (comma separated)."""
    numeric, other = split_column_kinds(df)
    dup = duplicate_count(df).scalar()
    base = df.agg(F.count(F.lit(1)).alias("rows"))
    return base.select(
        "rows", F.lit(len(df.columns)).alias("columns"), dup.alias("duplicate_rows"),
        F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(",".join(other)).alias("categorical_columns"),
        F.lit(",".join(selected_features)).alias("selected_features"))
