"""Dashboard and EDA reports over a cleaned incident table.

Every report is ``DataFrame -> DataFrame`` and lazy.  Plan shape, chosen for
very large inputs with heavily skewed keys (one borough can hold a third of all
rows):

* group-bys use Spark's partial (map-side) aggregation, so a hot key costs one
  small partial row per map task, never a hot shuffle partition;
* table-wide constants are either derived from the grouped rows themselves
  (global mean = sum of group sums / sum of group counts, a window over the
  few aggregated rows) or are scalar subqueries (min/max), handed to the
  consumer as a literal: no join and no cross product;
* exact quantiles (``percentile``) keep a value -> count map per group, which is
  bounded by the number of *distinct* target values (second resolution over
  0.5–60 minutes is < 3,600 values).  ``exact=False`` switches to
  ``percentile_approx`` for unbounded value domains;
* pivots always get explicit values, so they are a single aggregation pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S

def tgt() -> Column:
    return F.col(C.TARGET)


def quantiles(c: Column, probs: Sequence[float], exact: bool = True,
              accuracy: int = 10000) -> Column:
    """Array of quantiles with linear interpolation (exact) or approximate."""
    if exact:
        return F.percentile(c, F.array(*[F.lit(float(p)) for p in probs]))
    return F.percentile_approx(c, F.array(*[F.lit(float(p)) for p in probs]), accuracy)


def slow_share(c: Column | None = None) -> Column:
    c = tgt() if c is None else c
    return F.avg((c > F.lit(C.SLOW_RESPONSE_LIMIT)).cast("double"))


def mean_from_groups(sum_col: str = "_sum", count_col: str = "cases") -> Column:
    """Global mean from an already grouped table: sum of sums / sum of counts.

    Evaluated as a window over the *aggregated* rows (one row per group, e.g.
    five boroughs), so the input is scanned once.  A scalar subquery would be
    pruned to a different aggregate and re-run the whole input pipeline.
    """
    everything = Window.partitionBy()
    return F.sum(sum_col).over(everything) / F.sum(count_col).over(everything)


def global_mean(df: DataFrame) -> DataFrame:
    """Mean of the target (0.0 when the column is absent)."""
    if C.TARGET not in df.columns:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("global_mean"))
    return df.agg(F.avg(tgt()).alias("global_mean"))


def group_stats(df: DataFrame, keys: Sequence[str] = ("INCIDENT_CLASSIFICATION", "INCIDENT_DISPATCH_AREA", "BOROUGH")) -> DataFrame:
    """Mean and count per value of each key, all keys in one GROUPING SETS pass.

    Long form: (key_name, key_value, mean, n).
    """
    keys = [k for k in keys if k in df.columns]
    agg = df.groupingSets([[k] for k in keys], *keys).agg(
        F.avg(tgt()).alias("mean"), F.count(tgt()).alias("n"),
        *[F.grouping(k).alias(f"_g_{i}") for i, k in enumerate(keys)])
    name = None
    value = None
    for i, k in enumerate(keys):
        hit = F.col(f"_g_{i}") == 0
        name = F.when(hit, F.lit(k)) if name is None else name.when(hit, F.lit(k))
        value = F.when(hit, F.col(k).cast("string")) if value is None else value.when(hit, F.col(k).cast("string"))
    return agg.select(name.alias("key_name"), value.alias("key_value"), "mean", "n")


def mean_by(df: DataFrame, key: str, ascending_by_mean: bool | None = True) -> DataFrame:
    """Mean target per key; ordered by mean (A11) or by key."""
    out = df.groupBy(key).agg(F.avg(tgt()).alias("mean_minutes"))
    if ascending_by_mean is None:
        return out.orderBy(key)
    return out.orderBy(F.col("mean_minutes").asc() if ascending_by_mean else F.col("mean_minutes").desc(), key)


def top_mean_groups(df: DataFrame, key: str = "INCIDENT_CLASSIFICATION", k: int = 10,
                    min_cases: int = 0) -> DataFrame:
    """The k groups with the highest mean (optionally HAVING count >= min)."""
    out = df.groupBy(key).agg(F.avg(tgt()).alias("mean_minutes"), F.count(tgt()).alias("cases"))
    if min_cases:
        out = out.where(F.col("cases") >= F.lit(min_cases))
    return out.orderBy(F.col("mean_minutes").desc(), F.col(key)).limit(k)


def histogram(df: DataFrame, column: str = C.TARGET, bins: int = C.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed.

    All ``bins`` rows are returned, empty bins included.  One aggregate reads the
    two bounds, which then stand in the plan as constants; the counts are a
    partial aggregation on the bin index.
    """
    x = F.col(column)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        lo = hi = 0.0
    lo, hi = (float(lo) - 0.5, float(hi) + 0.5) if lo == hi else (float(lo), float(hi))
    idx = F.least(F.floor((x - F.lit(lo)) * F.lit(float(bins) / (hi - lo))), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    width = (hi - lo) / float(bins)
    return (grid.join(counts, "bin", "left")
                .select("bin",
                        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def response_kpis(df: DataFrame, exact: bool = True) -> DataFrame:
    """Count, mean, median, p90, p95 and share above 15 minutes."""
    q = quantiles(tgt(), [0.5, 0.9, 0.95], exact)
    return (df.where(tgt().isNotNull())
              .agg(F.count(tgt()).alias("cases"), F.avg(tgt()).alias("mean_minutes"), q.alias("q"),
                   slow_share().alias("slow_share"))
              .select("cases", "mean_minutes", F.col("q")[0].alias("median_minutes"),
                      F.col("q")[1].alias("p90_minutes"), F.col("q")[2].alias("p95_minutes"),
                      "slow_share"))


def borough_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """A16 (flagship): per borough count, mean, median, p90, slow share and
    improvement opportunity = max(mean - global mean, 0) * count, ordered by
    opportunity then mean, both descending."""
    q = quantiles(tgt(), [0.5, 0.9], exact)
    agg = df.groupBy("BOROUGH").agg(
        F.count(tgt()).alias("cases"), F.sum(tgt()).alias("_sum"), F.avg(tgt()).alias("mean_minutes"),
        q.alias("q"), slow_share().alias("slow_share"))
    agg = agg.withColumn("_g", mean_from_groups())
    g = F.col("_g")
    return (agg.select(
                "BOROUGH", "cases", "mean_minutes",
                F.col("q")[0].alias("median_minutes"), F.col("q")[1].alias("p90_minutes"),
                "slow_share",
                (S.clip_lower_zero(F.col("mean_minutes") - g) * F.col("cases")).alias("opportunity_minutes"))
              .orderBy(F.col("opportunity_minutes").desc(), F.col("mean_minutes").desc()))


def borough_summary_display(df: DataFrame, top: int = 8) -> DataFrame:
    """P19 + O3: the borough summary as shown: rounded to 2, share in percent, top rows."""
    s = borough_summary(df)
    return (s.select("BOROUGH", "cases",
                     *[S.round_half_up(F.col(c), 2).alias(c) for c in
                       ["mean_minutes", "median_minutes", "p90_minutes"]],
                     S.percent(F.col("slow_share"), 1).alias("slow_share_pct"),
                     S.round_half_up(F.col("opportunity_minutes"), 2).alias("opportunity_minutes"))
             .limit(top))


def dispatch_area_summary(df: DataFrame, min_cases: int = C.MIN_AREA_CASES, exact: bool = True) -> DataFrame:
    """Per dispatch area: modal borough, count (>= min_cases), mean, p90,
    mean dispatch delay in minutes, slow share and a priority label; ordered by
    priority rank then mean (descending)."""
    base = df.groupBy("INCIDENT_DISPATCH_AREA").agg(
        F.mode(F.col("BOROUGH").cast("string"), True).alias("BOROUGH"),
        F.count(tgt()).alias("cases"), F.sum(tgt()).alias("_sum"), F.avg(tgt()).alias("mean_minutes"),
        quantiles(tgt(), [0.9], exact).alias("q"),
        (F.avg("DISPATCH_RESPONSE_SECONDS_QY") / F.lit(60.0)).alias("dispatch_delay_minutes"),
        slow_share().alias("slow_share"),
    )
    agg = base.withColumn("_g", mean_from_groups()).where(F.col("cases") >= F.lit(min_cases))
    g = F.col("_g")
    pr = S.priority_label(F.col("mean_minutes"), F.col("slow_share"), g)
    return (agg.select("INCIDENT_DISPATCH_AREA", F.coalesce("BOROUGH", F.lit("")).alias("BOROUGH"),
                       "cases", "mean_minutes", F.col("q")[0].alias("p90_minutes"),
                       "dispatch_delay_minutes", "slow_share", pr.alias("priority"))
               .orderBy(S.priority_rank(F.col("priority")), F.col("mean_minutes").desc(), "INCIDENT_DISPATCH_AREA"))


def incident_summary(df: DataFrame, min_cases: int = C.MIN_INCIDENT_CASES, exact: bool = True) -> DataFrame:
    """Per classification with >= min_cases: count, mean, p90, slow share."""
    return (df.groupBy("INCIDENT_CLASSIFICATION")
              .agg(F.count(tgt()).alias("cases"), F.avg(tgt()).alias("mean_minutes"),
                   quantiles(tgt(), [0.9], exact).alias("q"), slow_share().alias("slow_share"))
              .where(F.col("cases") >= F.lit(min_cases))
              .select("INCIDENT_CLASSIFICATION", "cases", "mean_minutes",
                      F.col("q")[0].alias("p90_minutes"), "slow_share")
              .orderBy(F.col("mean_minutes").desc()))


def peak_hour(df: DataFrame) -> DataFrame:
    """The hour with the highest mean target (ties -> smallest hour)."""
    hourly = df.groupBy("Hour").agg(F.avg(tgt()).alias("mean_minutes"))
    best = F.max_by(F.struct("Hour", "mean_minutes"),
                    F.struct(F.col("mean_minutes"), -F.col("Hour")))
    return hourly.agg(best.alias("b")).select(
        F.col("b.Hour").alias("peak_hour"), F.col("b.mean_minutes").alias("peak_mean_minutes"))


def hour_table(df: DataFrame, k: int = 10) -> DataFrame:
    """Per hour count, mean, slow share; the k hours with the highest mean."""
    return (df.groupBy("Hour")
              .agg(F.count(tgt()).alias("cases"), F.avg(tgt()).alias("mean_minutes"), slow_share().alias("slow_share"))
              .orderBy(F.col("mean_minutes").desc(), "Hour").limit(k))


def pivot_mean(df: DataFrame, row: str, column: Column, values: Sequence, names: Sequence[str],
               fill: float | None = None) -> DataFrame:
    """Mean target pivot with explicit column values (one aggregation pass).

    ``fill`` replaces missing cells (T14: 0 for A33/A34, null for A22/A25).
    """
    aggs = []
    for v, n in zip(values, names):
        cell = F.avg(F.when(column == F.lit(v), tgt()))
        aggs.append((F.coalesce(cell, F.lit(float(fill))) if fill is not None else cell).alias(n))
    return df.groupBy(row).agg(*aggs).orderBy(row)


def borough_hour_heatmap(df: DataFrame) -> DataFrame:
    """Mean by borough x hour, columns h00..h23, gaps stay null."""
    return pivot_mean(df, "BOROUGH", F.col("Hour"), list(range(24)), [f"h{h:02d}" for h in range(24)])


def worst_areas(df: DataFrame, min_cases: int = C.MIN_WORST_AREA_CASES, k: int = 10) -> DataFrame:
    """Mean, count and sample std per dispatch area, count >= min, top k by mean."""
    return (df.groupBy("INCIDENT_DISPATCH_AREA")
              .agg(F.avg(tgt()).alias("mean_minutes"), F.count(tgt()).alias("cases"), F.stddev_samp(tgt()).alias("std_minutes"))
              .where(F.col("cases") >= F.lit(min_cases))
              .orderBy(F.col("mean_minutes").desc(), "INCIDENT_DISPATCH_AREA").limit(k))


def severity_means(df: DataFrame) -> DataFrame:
    """Mean and count per initial severity, highest mean first."""
    return (df.groupBy("INITIAL_SEVERITY_LEVEL_CODE")
              .agg(F.avg(tgt()).alias("mean_minutes"), F.count(tgt()).alias("cases"))
              .orderBy(F.col("mean_minutes").desc()))


def weekday_period_pivot(df: DataFrame) -> DataFrame:
    """Mean by weekday x day period (F13 bins), gaps stay null."""
    names = [name for _, name in C.DAY_PERIODS]
    return pivot_mean(df, "DayOfWeek", S.day_period("Hour"), names, names)


def severity_by_borough(df: DataFrame, severities: Sequence[float] | None = None) -> DataFrame:
    """Mean by borough x initial severity, missing cells 0.

    Pass ``severities`` when the code list is known; otherwise the distinct codes
    become the columns.  ``severity_by_borough_long`` has a row for each pair and
    suits any number of codes.
    """
    sev = "INITIAL_SEVERITY_LEVEL_CODE"
    if severities is None:
        severities = [r[0] for r in df.select(sev).where(F.col(sev).isNotNull()).distinct().orderBy(sev).collect()]
    names = [f"sev_{float(v):g}".replace(".", "_").replace("-", "m") for v in severities]
    return pivot_mean(df, "BOROUGH", F.col(sev), [float(v) for v in severities], names, fill=0.0)


def severity_by_borough_long(df: DataFrame) -> DataFrame:
    """A33 in long form: borough, severity, mean."""
    sev = "INITIAL_SEVERITY_LEVEL_CODE"
    return df.where(F.col(sev).isNotNull()).groupBy("BOROUGH", sev).agg(F.avg(tgt()).alias("mean_minutes"))


def peak_offpeak(df: DataFrame) -> DataFrame:
    """Per borough mean in rush hours and outside (missing -> 0), each
    rounded to 2 decimals first, and their difference."""
    peak = F.col("Hour").isin(C.RUSH_HOURS)
    agg = df.groupBy("BOROUGH").agg(
        F.coalesce(F.avg(F.when(~peak, tgt())), F.lit(0.0)).alias("o"),
        F.coalesce(F.avg(F.when(peak, tgt())), F.lit(0.0)).alias("p"))
    o = S.round_half_up(F.col("o"), 2)
    p = S.round_half_up(F.col("p"), 2)
    return (agg.select("BOROUGH", o.alias("offpeak_mean_minutes"), p.alias("peak_mean_minutes"),
                       S.round_half_up(p - o, 2).alias("peak_minus_offpeak"))
               .orderBy("BOROUGH"))


def monthly_trend(df: DataFrame) -> DataFrame:
    """Mean and count per month."""
    return df.groupBy("Month").agg(F.avg(tgt()).alias("mean_minutes"), F.count(tgt()).alias("cases")).orderBy("Month")


def context_kpis(df: DataFrame) -> DataFrame:
    """Rows, columns, distinct boroughs and dispatch areas, first and last date."""
    d = F.to_date(F.col(C.INCIDENT_DATETIME).cast("timestamp_ntz"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.countDistinct("BOROUGH").alias("boroughs"),
        F.countDistinct("INCIDENT_DISPATCH_AREA").alias("dispatch_areas"),
        F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values, sorted by their text form."""
    return (df.select(column).where(F.col(column).isNotNull()).distinct()
              .orderBy(F.col(column).cast("string")))


def most_common_values(df: DataFrame, column: str, limit: int = 60) -> DataFrame:
    """A38 + P12: the most frequent non-blank values (text), top ``limit``."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (df.select(v.alias(column)).where(S.trimmed(F.col(column)) != F.lit(""))
              .groupBy(column).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(column)).limit(limit))


def modal_value(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Most frequent value as text, ties -> smallest, empty -> ''."""
    m = F.coalesce(F.mode(F.col(column).cast("string"), True), F.lit("")).alias(f"modal_{column}")
    return df.agg(m) if by is None else df.groupBy(by).agg(m).orderBy(by)


def options_by(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Cascaded option lists: distinct child values per parent value."""
    return (df.select(parent, child).where(F.col(child).isNotNull()).distinct()
              .orderBy(parent, F.col(child).cast("string")))


# --- J5: code -> label dimension lookups --------------------------------------
# Display names for weekday codes (Monday = 0) and month codes.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]


def label_table(spark, codes: Sequence, labels: Sequence[str], code_col: str = "code") -> DataFrame:
    """A small code -> label dimension table (size fixed by the code list)."""
    return spark.createDataFrame(list(zip(codes, labels)), f"{code_col} int, label string")


def attach_labels(df: DataFrame, column: str, labels: DataFrame, label_col: str) -> DataFrame:
    """Broadcast left join to a code -> label dimension; a missing code keeps
    its own text.  The dimension is a fixed list (7 or 12 rows), so broadcasting
    it is size-safe."""
    dim = labels.withColumnRenamed("code", "_code").withColumnRenamed("label", "_label")
    out = df.join(F.broadcast(dim), df[column] == dim["_code"], "left")
    return out.withColumn(label_col, F.coalesce(F.col("_label"), F.col(column).cast("string"))).drop("_code", "_label")


def monthly_trend_labeled(df: DataFrame) -> DataFrame:
    """A35 with month names."""
    months = label_table(df.sparkSession, list(range(1, 13)), MONTH_NAMES)
    return attach_labels(monthly_trend(df), "Month", months, "month_name").orderBy("Month")


def weekday_period_labeled(df: DataFrame) -> DataFrame:
    """A25 with weekday names."""
    days = label_table(df.sparkSession, list(range(7)), WEEKDAY_NAMES)
    return attach_labels(weekday_period_pivot(df), "DayOfWeek", days, "day_name").orderBy("DayOfWeek")
