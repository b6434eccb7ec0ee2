"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the driver tables, rebuilds an incident view, cleans it and
runs one operator over the whole table.  ``finalize`` rounds double columns
with the same formula the oracle SQL uses.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

from ..functions import scalars as S
from ..operators import clean as CL
from ..operators import causal as CA
from ..operators import evaluate as E
from ..operators import explain as X
from ..operators import features as FE
from ..operators import learning as LN
from ..operators import profile as P
from ..operators import reports as R
from ..operators import trends as TR
from ..sources import fixtures as FX
from ..sources import readers as SR
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]


def finalize(df: DataFrame, digits: int = 4) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(S.round_half_up(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def events_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 cleaned (the main correctness fixture)."""
    return CL.clean_incidents(FX.incidents_events(spark, sf_dir))


def orders_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 cleaned (multi-year, typed timestamps)."""
    return CL.clean_incidents(FX.incidents_orders(spark, sf_dir))


# --------------------------------------------------------------------------
# registry
# --------------------------------------------------------------------------
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ev_sql(body: str, dbl: list[str], extra: list[str] | None = None) -> str:
    return O.rounded(O.with_ctes(O.EV + (extra or []), body), dbl)


def ord_sql(body: str, dbl: list[str], extra: list[str] | None = None) -> str:
    return O.rounded(O.with_ctes(O.ORD + (extra or []), body), dbl)


# --- cleaning ---------------------------------------------------------------
EV_DOUBLES = ["INITIAL_SEVERITY_LEVEL_CODE", "FINAL_SEVERITY_LEVEL_CODE", "DISPATCH_RESPONSE_SECONDS_QY",
              "INCIDENT_RESPONSE_SECONDS_QY", "Response_Time_Minutes"]
ORD_DOUBLES = ["INITIAL_SEVERITY_LEVEL_CODE", "INCIDENT_RESPONSE_SECONDS_QY", "Response_Time_Minutes"]


@register("p6_clean_events", ev_sql("SELECT * FROM ev", EV_DOUBLES))
def q_clean_events(spark, sf_dir):
    return finalize(events_clean(spark, sf_dir))


@register("p6_clean_orders", ord_sql("SELECT * FROM ord", ORD_DOUBLES))
def q_clean_orders(spark, sf_dir):
    return finalize(orders_clean(spark, sf_dir))


# --- reports ----------------------------------------------------------------
@register("a16_borough_summary", ev_sql("""
SELECT BOROUGH, count(Response_Time_Minutes) AS cases, avg(Response_Time_Minutes) AS mean_minutes,
  quantile_cont(Response_Time_Minutes, 0.5) AS median_minutes,
  quantile_cont(Response_Time_Minutes, 0.9) AS p90_minutes,
  avg(CASE WHEN Response_Time_Minutes > 15.0 THEN 1.0 ELSE 0.0 END) AS slow_share,
  greatest(avg(Response_Time_Minutes) - (SELECT avg(Response_Time_Minutes) FROM ev), 0.0)
    * count(Response_Time_Minutes) AS opportunity_minutes
FROM ev GROUP BY BOROUGH""", ["mean_minutes", "median_minutes", "p90_minutes", "slow_share", "opportunity_minutes"]))
def q_borough_summary(spark, sf_dir):
    return finalize(R.borough_summary(events_clean(spark, sf_dir)))


TG = "Response_Time_Minutes"
SLOW = f"CASE WHEN {TG} > 15.0 THEN 1.0 ELSE 0.0 END"
RUSH = "(7, 8, 9, 17, 18, 19)"


def r2(expr: str) -> str:
    return O.r(expr, 2)


@register("a6_global_mean", ev_sql(f"SELECT avg({TG}) AS global_mean FROM ev", ["global_mean"]))
def q_global_mean(spark, sf_dir):
    return finalize(R.global_mean(events_clean(spark, sf_dir)))


@register("a7_group_stats", ev_sql(" UNION ALL ".join(
    f"SELECT '{k}' AS key_name, CAST({k} AS VARCHAR) AS key_value, avg({TG}) AS mean, count({TG}) AS n FROM ev GROUP BY {k}"
    for k in ["INCIDENT_CLASSIFICATION", "INCIDENT_DISPATCH_AREA", "BOROUGH"]), ["mean"]))
def q_group_stats(spark, sf_dir):
    return finalize(R.group_stats(events_clean(spark, sf_dir)))


@register("a11_mean_by_borough", ev_sql(f"SELECT BOROUGH, avg({TG}) AS mean_minutes FROM ev GROUP BY BOROUGH", ["mean_minutes"]))
def q_mean_by_borough(spark, sf_dir):
    return finalize(R.mean_by(events_clean(spark, sf_dir), "BOROUGH", True))


@register("a12_mean_by_hour", ev_sql(f"SELECT Hour, avg({TG}) AS mean_minutes FROM ev GROUP BY Hour", ["mean_minutes"]))
def q_mean_by_hour(spark, sf_dir):
    return finalize(R.mean_by(events_clean(spark, sf_dir), "Hour", None))


@register("a13_top_classifications", ev_sql(f"""
SELECT INCIDENT_CLASSIFICATION, avg({TG}) AS mean_minutes, count({TG}) AS cases FROM ev
GROUP BY 1 ORDER BY mean_minutes DESC, 1 LIMIT 10""", ["mean_minutes"]))
def q_top_classifications(spark, sf_dir):
    return finalize(R.top_mean_groups(events_clean(spark, sf_dir), "INCIDENT_CLASSIFICATION", 10))


def hist_sql(src: str, col: str, bins: int = 50) -> str:
    return f"""SELECT g.bin, s2.lo + g.bin * ((s2.hi - s2.lo) / {bins}.0) AS bin_start,
  s2.lo + (g.bin + 1) * ((s2.hi - s2.lo) / {bins}.0) AS bin_end, coalesce(c.cnt, 0) AS count
FROM range({bins}) g(bin)
CROSS JOIN (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                   CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
            FROM (SELECT min({col}) AS lo0, max({col}) AS hi0 FROM {src})) s2
LEFT JOIN (SELECT CAST(least(floor(({col} - s3.lo) * ({bins}.0 / (s3.hi - s3.lo))), {bins - 1}) AS BIGINT) AS bin, count(*) AS cnt
           FROM {src}, (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                               CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
                        FROM (SELECT min({col}) AS lo0, max({col}) AS hi0 FROM {src})) s3
           WHERE {col} IS NOT NULL GROUP BY 1) c ON c.bin = g.bin"""


@register("a14_target_histogram", ev_sql(hist_sql("ev", TG), ["bin_start", "bin_end"]))
def q_target_histogram(spark, sf_dir):
    return finalize(R.histogram(events_clean(spark, sf_dir)))


@register("a15_response_kpis", ev_sql(f"""
SELECT count({TG}) AS cases, avg({TG}) AS mean_minutes, quantile_cont({TG}, 0.5) AS median_minutes,
  quantile_cont({TG}, 0.9) AS p90_minutes, quantile_cont({TG}, 0.95) AS p95_minutes, avg({SLOW}) AS slow_share
FROM ev""", ["mean_minutes", "median_minutes", "p90_minutes", "p95_minutes", "slow_share"]))
def q_response_kpis(spark, sf_dir):
    return finalize(R.response_kpis(events_clean(spark, sf_dir)))


MODAL_BOROUGH = f"""modal AS (
SELECT INCIDENT_DISPATCH_AREA, BOROUGH,
  row_number() OVER (PARTITION BY INCIDENT_DISPATCH_AREA ORDER BY count(*) DESC, BOROUGH) AS rn
FROM ev GROUP BY 1, 2)"""


AREA_SUMMARY = f"""
SELECT a.INCIDENT_DISPATCH_AREA, m.BOROUGH, a.cases, a.mean_minutes, a.p90_minutes, a.dispatch_delay_minutes,
  a.slow_share,
  CASE WHEN a.mean_minutes >= g.gm + 1.25 AND a.slow_share >= 0.2 THEN 'high'
       WHEN a.mean_minutes >= g.gm + 0.5 THEN 'medium' ELSE 'watch' END AS priority
FROM (SELECT INCIDENT_DISPATCH_AREA, count({TG}) AS cases, avg({TG}) AS mean_minutes,
        quantile_cont({TG}, 0.9) AS p90_minutes, avg(DISPATCH_RESPONSE_SECONDS_QY) / 60.0 AS dispatch_delay_minutes,
        avg({SLOW}) AS slow_share
      FROM ev GROUP BY 1 HAVING count({TG}) >= 80) a
JOIN modal m ON m.INCIDENT_DISPATCH_AREA = a.INCIDENT_DISPATCH_AREA AND m.rn = 1
CROSS JOIN (SELECT avg({TG}) AS gm FROM ev) g"""


@register("a17_dispatch_area_summary", ev_sql(AREA_SUMMARY,
    ["mean_minutes", "p90_minutes", "dispatch_delay_minutes", "slow_share"], [MODAL_BOROUGH]))
def q_dispatch_area_summary(spark, sf_dir):
    return finalize(R.dispatch_area_summary(events_clean(spark, sf_dir)))


def numbered(df: DataFrame) -> DataFrame:
    """A sorted report of few rows with its rows numbered in their order."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@register("o1_area_order", ev_sql(f"""
SELECT INCIDENT_DISPATCH_AREA, row_number() OVER (
  ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, mean_minutes DESC, INCIDENT_DISPATCH_AREA) AS place
FROM ({AREA_SUMMARY})""", [], [MODAL_BOROUGH]))
def q_area_order(spark, sf_dir):
    return numbered(R.dispatch_area_summary(events_clean(spark, sf_dir))).select("INCIDENT_DISPATCH_AREA", "place")


@register("o5_hour_order", ev_sql(f"""
SELECT Hour, row_number() OVER (ORDER BY Hour) AS place FROM (SELECT DISTINCT Hour FROM ev)""", []))
def q_hour_order(spark, sf_dir):
    return numbered(R.mean_by(events_clean(spark, sf_dir), "Hour", None)).select("Hour", "place")


@register("a18_incident_summary", ev_sql(f"""
SELECT INCIDENT_CLASSIFICATION, count({TG}) AS cases, avg({TG}) AS mean_minutes,
  quantile_cont({TG}, 0.9) AS p90_minutes, avg({SLOW}) AS slow_share
FROM ev GROUP BY 1 HAVING count({TG}) >= 80""", ["mean_minutes", "p90_minutes", "slow_share"]))
def q_incident_summary(spark, sf_dir):
    return finalize(R.incident_summary(events_clean(spark, sf_dir)))


@register("a20_peak_hour", ev_sql(f"""
SELECT Hour AS peak_hour, m AS peak_mean_minutes
FROM (SELECT Hour, avg({TG}) AS m FROM ev GROUP BY Hour) ORDER BY m DESC, Hour LIMIT 1""", ["peak_mean_minutes"]))
def q_peak_hour(spark, sf_dir):
    return finalize(R.peak_hour(events_clean(spark, sf_dir)))


@register("a21_hour_table", ev_sql(f"""
SELECT Hour, count({TG}) AS cases, avg({TG}) AS mean_minutes, avg({SLOW}) AS slow_share
FROM ev GROUP BY Hour ORDER BY mean_minutes DESC, Hour LIMIT 10""", ["mean_minutes", "slow_share"]))
def q_hour_table(spark, sf_dir):
    return finalize(R.hour_table(events_clean(spark, sf_dir)))


HOURS = [f"h{h:02d}" for h in range(24)]


@register("a22_borough_hour_heatmap", ev_sql(
    "SELECT BOROUGH, " + ", ".join(f"avg({TG}) FILTER (WHERE Hour = {h}) AS h{h:02d}" for h in range(24))
    + " FROM ev GROUP BY BOROUGH", HOURS))
def q_heatmap(spark, sf_dir):
    return finalize(R.borough_hour_heatmap(events_clean(spark, sf_dir)))


@register("a23_worst_areas", ev_sql(f"""
SELECT INCIDENT_DISPATCH_AREA, avg({TG}) AS mean_minutes, count({TG}) AS cases, stddev_samp({TG}) AS std_minutes
FROM ev GROUP BY 1 HAVING count({TG}) >= 20 ORDER BY mean_minutes DESC, 1 LIMIT 10""", ["mean_minutes", "std_minutes"]))
def q_worst_areas(spark, sf_dir):
    return finalize(R.worst_areas(events_clean(spark, sf_dir)))


@register("a24_severity_means", ev_sql(f"""
SELECT INITIAL_SEVERITY_LEVEL_CODE, avg({TG}) AS mean_minutes, count({TG}) AS cases FROM ev GROUP BY 1""",
    ["INITIAL_SEVERITY_LEVEL_CODE", "mean_minutes"]))
def q_severity_means(spark, sf_dir):
    return finalize(R.severity_means(events_clean(spark, sf_dir)))


PERIOD = ("CASE WHEN Hour <= 6 THEN 'night' WHEN Hour <= 12 THEN 'morning' "
          "WHEN Hour <= 18 THEN 'noon' WHEN Hour <= 24 THEN 'evening' END")
PERIODS = ["night", "morning", "noon", "evening"]


@register("a25_weekday_period_pivot", ev_sql(
    "SELECT DayOfWeek, " + ", ".join(f"avg({TG}) FILTER (WHERE period = '{p}') AS {p}" for p in PERIODS)
    + f" FROM (SELECT *, {PERIOD} AS period FROM ev) GROUP BY DayOfWeek", PERIODS))
def q_weekday_period(spark, sf_dir):
    return finalize(R.weekday_period_pivot(events_clean(spark, sf_dir)))


@register("a26_top_classifications_min50", ev_sql(f"""
SELECT INCIDENT_CLASSIFICATION, avg({TG}) AS mean_minutes, count({TG}) AS cases FROM ev
GROUP BY 1 HAVING count({TG}) >= 50 ORDER BY mean_minutes DESC, 1 LIMIT 10""", ["mean_minutes"]))
def q_top_classifications_min50(spark, sf_dir):
    return finalize(R.top_mean_groups(events_clean(spark, sf_dir), "INCIDENT_CLASSIFICATION", 10, min_cases=50))


# X7 severity codes are the leading digit of the order priority: 1..5.
ORDER_SEVERITIES = [1.0, 2.0, 3.0, 4.0, 5.0]


@register("a33_severity_by_borough", ord_sql(
    "SELECT BOROUGH, " + ", ".join(
        f"coalesce(avg({TG}) FILTER (WHERE INITIAL_SEVERITY_LEVEL_CODE = {v}), 0.0) AS sev_{int(v)}"
        for v in ORDER_SEVERITIES) + " FROM ord GROUP BY BOROUGH", [f"sev_{int(v)}" for v in ORDER_SEVERITIES]))
def q_severity_by_borough(spark, sf_dir):
    return finalize(R.severity_by_borough(orders_clean(spark, sf_dir), ORDER_SEVERITIES))


@register("a34_peak_offpeak", ev_sql(f"""
SELECT BOROUGH, {r2('o')} AS offpeak_mean_minutes, {r2('p')} AS peak_mean_minutes,
  {r2(r2('p') + ' - ' + r2('o'))} AS peak_minus_offpeak
FROM (SELECT BOROUGH, coalesce(avg({TG}) FILTER (WHERE Hour NOT IN {RUSH}), 0.0) AS o,
             coalesce(avg({TG}) FILTER (WHERE Hour IN {RUSH}), 0.0) AS p
      FROM ev GROUP BY BOROUGH)""", ["offpeak_mean_minutes", "peak_mean_minutes", "peak_minus_offpeak"]))
def q_peak_offpeak(spark, sf_dir):
    return finalize(R.peak_offpeak(events_clean(spark, sf_dir)))


@register("a35_monthly_trend", ord_sql(
    f"SELECT Month, avg({TG}) AS mean_minutes, count({TG}) AS cases FROM ord GROUP BY Month", ["mean_minutes"]))
def q_monthly_trend(spark, sf_dir):
    return finalize(R.monthly_trend(orders_clean(spark, sf_dir)))


EV_CLEAN_COLUMNS = [
    ("CAD_INCIDENT_ID", "n"), ("INCIDENT_DATETIME", "o"), ("FIRST_ON_SCENE_DATETIME", "o"), ("BOROUGH", "o"),
    ("INCIDENT_DISPATCH_AREA", "o"), ("INITIAL_CALL_TYPE", "o"), ("FINAL_CALL_TYPE", "o"),
    ("INITIAL_SEVERITY_LEVEL_CODE", "d"), ("FINAL_SEVERITY_LEVEL_CODE", "d"), ("DISPATCH_RESPONSE_SECONDS_QY", "d"),
    ("INCIDENT_RESPONSE_SECONDS_QY", "d"), ("VALID_INCIDENT_RSPNS_TIME_INDC", "o"), ("HELD_INDICATOR", "o"),
    ("REOPEN_INDICATOR", "o"), ("ZIPCODE", "o"), ("INCIDENT_CLASSIFICATION", "o"), (TG, "d"), ("Hour", "n"),
    ("DayOfWeek", "n"), ("Month", "n"), ("IsHeld", "n"), ("IsReopen", "n"),
]


@register("a36_context_kpis", ev_sql(f"""
SELECT count(*) AS rows, {len(EV_CLEAN_COLUMNS)} AS columns, count(DISTINCT BOROUGH) AS boroughs,
  count(DISTINCT INCIDENT_DISPATCH_AREA) AS dispatch_areas,
  CAST(min(CAST(INCIDENT_DATETIME AS DATE)) AS VARCHAR) AS first_date,
  CAST(max(CAST(INCIDENT_DATETIME AS DATE)) AS VARCHAR) AS last_date
FROM ev""", []))
def q_context_kpis(spark, sf_dir):
    k = R.context_kpis(events_clean(spark, sf_dir))
    return k.withColumns({c: F.col(c).cast("string") for c in ["first_date", "last_date"]})


@register("a37_unique_boroughs", ev_sql("SELECT DISTINCT BOROUGH FROM ev WHERE BOROUGH IS NOT NULL", []))
def q_unique_boroughs(spark, sf_dir):
    return R.unique_values(events_clean(spark, sf_dir), "BOROUGH")


@register("a38_most_common_classifications", ev_sql("""
SELECT INCIDENT_CLASSIFICATION, count(*) AS count FROM
 (SELECT coalesce(CAST(INCIDENT_CLASSIFICATION AS VARCHAR), '') AS INCIDENT_CLASSIFICATION FROM ev)
WHERE trim(INCIDENT_CLASSIFICATION) <> '' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 60""", []))
def q_most_common(spark, sf_dir):
    return R.most_common_values(events_clean(spark, sf_dir), "INCIDENT_CLASSIFICATION", 60)


@register("a39_modal_classification_by_borough", ev_sql("""
SELECT BOROUGH, INCIDENT_CLASSIFICATION AS modal_INCIDENT_CLASSIFICATION FROM (
  SELECT BOROUGH, INCIDENT_CLASSIFICATION,
    row_number() OVER (PARTITION BY BOROUGH ORDER BY count(*) DESC, INCIDENT_CLASSIFICATION) AS rn
  FROM ev GROUP BY 1, 2) WHERE rn = 1""", []))
def q_modal(spark, sf_dir):
    return R.modal_value(events_clean(spark, sf_dir), "INCIDENT_CLASSIFICATION", by="BOROUGH")


@register("p11_dispatch_options_by_borough", ev_sql(
    "SELECT DISTINCT BOROUGH, INCIDENT_DISPATCH_AREA FROM ev WHERE INCIDENT_DISPATCH_AREA IS NOT NULL", []))
def q_options(spark, sf_dir):
    return R.options_by(events_clean(spark, sf_dir), "BOROUGH", "INCIDENT_DISPATCH_AREA")


@register("p19_borough_summary_display", ev_sql(f"""
SELECT BOROUGH, cases, {r2('mean_minutes')} AS mean_minutes, {r2('median_minutes')} AS median_minutes,
  {r2('p90_minutes')} AS p90_minutes, {O.r('slow_share * 100.0', 1)} AS slow_share_pct,
  {r2('opportunity_minutes')} AS opportunity_minutes
FROM (SELECT BOROUGH, count({TG}) AS cases, avg({TG}) AS mean_minutes,
        quantile_cont({TG}, 0.5) AS median_minutes, quantile_cont({TG}, 0.9) AS p90_minutes,
        avg({SLOW}) AS slow_share,
        greatest(avg({TG}) - (SELECT avg({TG}) FROM ev), 0.0) * count({TG}) AS opportunity_minutes
      FROM ev GROUP BY BOROUGH)
ORDER BY opportunity_minutes DESC, mean_minutes DESC LIMIT 8""",
    ["mean_minutes", "median_minutes", "p90_minutes", "slow_share_pct", "opportunity_minutes"]))
def q_borough_display(spark, sf_dir):
    return finalize(R.borough_summary_display(events_clean(spark, sf_dir)))


MONTHS_SQL = "CASE Month " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(R.MONTH_NAMES)) + \
    " ELSE CAST(Month AS VARCHAR) END"
DAYS_SQL = "CASE DayOfWeek " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(R.WEEKDAY_NAMES)) + \
    " ELSE CAST(DayOfWeek AS VARCHAR) END"


@register("j5_monthly_trend_labeled", ord_sql(
    f"SELECT Month, avg({TG}) AS mean_minutes, count({TG}) AS cases, {MONTHS_SQL} AS month_name FROM ord GROUP BY Month",
    ["mean_minutes"]))
def q_monthly_labeled(spark, sf_dir):
    return finalize(R.monthly_trend_labeled(orders_clean(spark, sf_dir)))


@register("j5_weekday_period_labeled", ev_sql(
    "SELECT DayOfWeek, " + ", ".join(f"avg({TG}) FILTER (WHERE period = '{p}') AS {p}" for p in PERIODS)
    + f", {DAYS_SQL} AS day_name FROM (SELECT *, {PERIOD} AS period FROM ev) GROUP BY DayOfWeek", PERIODS))
def q_weekday_labeled(spark, sf_dir):
    return finalize(R.weekday_period_labeled(events_clean(spark, sf_dir)))


# --- roadmap trends (R4, R5, R7, R8, R10) ------------------------------------
@register("r4_holiday_comparison", ord_sql(f"""
SELECT CASE WHEN (month(INCIDENT_DATETIME) = 1 AND day(INCIDENT_DATETIME) = 1)
              OR (month(INCIDENT_DATETIME) = 7 AND day(INCIDENT_DATETIME) = 4)
              OR (month(INCIDENT_DATETIME) = 12 AND day(INCIDENT_DATETIME) = 25) THEN 1 ELSE 0 END AS IsHoliday,
  avg({TG}) AS mean_minutes, count({TG}) AS cases
FROM ord GROUP BY 1""", ["mean_minutes"]))
def q_holiday(spark, sf_dir):
    return finalize(TR.holiday_comparison(orders_clean(spark, sf_dir)))


@register("r5_borough_prev7d_avg", ord_sql(f"""
SELECT o.CAD_INCIDENT_ID, r.v AS Borough_Prev7d_Avg
FROM ord o LEFT JOIN (
  SELECT BOROUGH, d, sum(s) OVER w / sum(n) OVER w AS v
  FROM (SELECT BOROUGH, CAST(INCIDENT_DATETIME AS DATE) AS d, sum({TG}) AS s, count({TG}) AS n
        FROM ord WHERE {TG} IS NOT NULL GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY BOROUGH ORDER BY CAST(d - DATE '1970-01-01' AS BIGINT)
               RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)) r
ON r.BOROUGH = o.BOROUGH AND r.d = CAST(o.INCIDENT_DATETIME AS DATE)""", ["Borough_Prev7d_Avg"]))
def q_prev7d(spark, sf_dir):
    return finalize(TR.add_borough_prev7d_avg(orders_clean(spark, sf_dir)).select(C.KEY, "Borough_Prev7d_Avg"))


@register("r7_worst_borough_hours", ev_sql(f"""
SELECT BOROUGH, Hour, avg({TG}) AS mean_minutes, count({TG}) AS cases FROM ev
GROUP BY 1, 2 ORDER BY mean_minutes DESC, BOROUGH, Hour LIMIT 5""", ["mean_minutes"]))
def q_worst_segments(spark, sf_dir):
    return finalize(TR.worst_segments(events_clean(spark, sf_dir)))


@register("r8_monthly_trend_by_borough", ord_sql(f"""
SELECT BOROUGH, strftime(INCIDENT_DATETIME, '%Y-%m') AS year_month, avg({TG}) AS mean_minutes, count({TG}) AS cases
FROM ord GROUP BY 1, 2""", ["mean_minutes"]))
def q_monthly_by_borough(spark, sf_dir):
    return finalize(TR.monthly_trend_by(orders_clean(spark, sf_dir)))


# Fixed parameters of the registered 2x2 comparison.
DID_TREATED = ["EUROPE"]
DID_CUT = "1998-01-01 00:00:00"


@register("r10_difference_in_differences", ord_sql(f"""
SELECT avg({TG}) FILTER (WHERE BOROUGH = 'EUROPE' AND INCIDENT_DATETIME < TIMESTAMP '{DID_CUT}') AS treated_before,
  avg({TG}) FILTER (WHERE BOROUGH = 'EUROPE' AND INCIDENT_DATETIME >= TIMESTAMP '{DID_CUT}') AS treated_after,
  avg({TG}) FILTER (WHERE BOROUGH <> 'EUROPE' AND INCIDENT_DATETIME < TIMESTAMP '{DID_CUT}') AS control_before,
  avg({TG}) FILTER (WHERE BOROUGH <> 'EUROPE' AND INCIDENT_DATETIME >= TIMESTAMP '{DID_CUT}') AS control_after,
  (avg({TG}) FILTER (WHERE BOROUGH = 'EUROPE' AND INCIDENT_DATETIME >= TIMESTAMP '{DID_CUT}')
   - avg({TG}) FILTER (WHERE BOROUGH = 'EUROPE' AND INCIDENT_DATETIME < TIMESTAMP '{DID_CUT}'))
  - (avg({TG}) FILTER (WHERE BOROUGH <> 'EUROPE' AND INCIDENT_DATETIME >= TIMESTAMP '{DID_CUT}')
   - avg({TG}) FILTER (WHERE BOROUGH <> 'EUROPE' AND INCIDENT_DATETIME < TIMESTAMP '{DID_CUT}')) AS did
FROM ord""", ["treated_before", "treated_after", "control_before", "control_after", "did"]))
def q_did(spark, sf_dir):
    cut = F.lit(DID_CUT).cast("timestamp_ntz")
    return finalize(TR.difference_in_differences(orders_clean(spark, sf_dir), "BOROUGH", DID_TREATED, cut))


@register("r6_area_last5_avg", ord_sql(f"""
SELECT CAD_INCIDENT_ID, avg({TG}) OVER (PARTITION BY INCIDENT_DISPATCH_AREA ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID
                                        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DispatchArea_Last5_Avg
FROM ord""", ["DispatchArea_Last5_Avg"]))
def q_last5(spark, sf_dir):
    return finalize(TR.add_area_lastn_avg(orders_clean(spark, sf_dir), 5).select(C.KEY, "DispatchArea_Last5_Avg"))


@register("r3_concurrent_incidents", ord_sql("""
SELECT i.CAD_INCIDENT_ID, CAST(count(j.CAD_INCIDENT_ID) AS BIGINT) AS concurrent_incidents
FROM ord i LEFT JOIN ord j ON j.INCIDENT_DATETIME <= i.INCIDENT_DATETIME AND j.FIRST_ON_SCENE_DATETIME > i.INCIDENT_DATETIME
  AND j.CAD_INCIDENT_ID <> i.CAD_INCIDENT_ID
GROUP BY 1""", []))
def q_concurrent(spark, sf_dir):
    return TR.add_concurrent_incidents(orders_clean(spark, sf_dir)).select(C.KEY, "concurrent_incidents")


# --- profile ----------------------------------------------------------------
def _missing_sql(name: str, kind: str) -> str:
    cond = f"{name} IS NULL" + (f" OR isnan({name})" if kind == "d" else "")
    return f"SELECT '{name}' AS column_name, count(*) FILTER (WHERE {cond}) AS missing FROM ev"


MISSING_SQL = " UNION ALL ".join(_missing_sql(n, k) for n, k in EV_CLEAN_COLUMNS)


@register("a3_missing_values", ev_sql(MISSING_SQL, []))
def q_missing(spark, sf_dir):
    return P.missing_counts(events_clean(spark, sf_dir))


@register("a4_missing_ratio_top8", ev_sql(f"""
SELECT column_name, missing / (SELECT count(*) FROM ev) AS missing_ratio FROM ({MISSING_SQL})
ORDER BY missing_ratio DESC, column_name LIMIT 8""", ["missing_ratio"]))
def q_missing_top(spark, sf_dir):
    return finalize(P.missing_ratio_top(events_clean(spark, sf_dir)))


MF_NUMERIC = ["Hour", "DayOfWeek", "Month", "INITIAL_SEVERITY_LEVEL_CODE", "FINAL_SEVERITY_LEVEL_CODE",
              "DISPATCH_RESPONSE_SECONDS_QY", "IsHeld", "IsReopen"]
MF_CATEGORICAL = ["BOROUGH", "INCIDENT_CLASSIFICATION", "INCIDENT_DISPATCH_AREA", "ZIPCODE"]
MF_COLS = MF_NUMERIC + MF_CATEGORICAL + [TG]
MF_SQL = "mf AS (SELECT CAD_INCIDENT_ID, " + ", ".join(MF_COLS) + " FROM ev WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in MF_COLS) + ")"


@register("p8_model_frame", ev_sql("SELECT * FROM mf", [
    "INITIAL_SEVERITY_LEVEL_CODE", "FINAL_SEVERITY_LEVEL_CODE", "DISPATCH_RESPONSE_SECONDS_QY", TG], [MF_SQL]))
def q_model_frame(spark, sf_dir):
    frame, _, _ = CL.make_model_frame(events_clean(spark, sf_dir))
    return finalize(frame)


@register("a2_duplicate_rows", ev_sql(
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM mf GROUP BY "
    + ", ".join(MF_COLS) + ")", [], [MF_SQL]))
def q_duplicates(spark, sf_dir):
    frame, _, _ = CL.make_model_frame(events_clean(spark, sf_dir), keep=())
    return P.duplicate_count(frame)


def _kinds(kind: str) -> str:
    return ",".join(n for n, k in EV_CLEAN_COLUMNS if (k in "nd") == (kind == "num"))


@register("a1_profile", ev_sql(f"""
SELECT count(*) AS rows, {len(EV_CLEAN_COLUMNS)} AS columns,
  (SELECT CAST(count(*) - count(DISTINCT ev) AS BIGINT) FROM ev) AS duplicate_rows,
  '{_kinds("num")}' AS numeric_columns, '{_kinds("other")}' AS categorical_columns,
  '{",".join(MF_NUMERIC + MF_CATEGORICAL)}' AS selected_features
FROM ev""", []))
def q_profile(spark, sf_dir):
    df = events_clean(spark, sf_dir)
    num, cat = CL.feature_columns(df)
    return P.profile(df, num + cat)


# --- features (F8, F9, A8–A10, P9) -----------------------------------------
TWO_PI = "6.283185307179586"
CYC_SQL = (f"sin({TWO_PI} * (Hour - 0) / 24.0) AS Hour_sin, cos({TWO_PI} * (Hour - 0) / 24.0) AS Hour_cos, "
           f"sin({TWO_PI} * (DayOfWeek - 0) / 7.0) AS DayOfWeek_sin, cos({TWO_PI} * (DayOfWeek - 0) / 7.0) AS DayOfWeek_cos, "
           f"sin({TWO_PI} * (Month - 1) / 12.0) AS Month_sin, cos({TWO_PI} * (Month - 1) / 12.0) AS Month_cos")
CTX_SQL = ("CAST(DayOfWeek >= 5 AS INTEGER) AS IsWeekend, CAST(Hour >= 22 OR Hour <= 5 AS INTEGER) AS IsNight, "
           "CAST(Hour IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS IsRushHour")
CYC_COLS = ["Hour_sin", "Hour_cos", "DayOfWeek_sin", "DayOfWeek_cos", "Month_sin", "Month_cos"]
CTX_COLS = ["IsWeekend", "IsNight", "IsRushHour"]
TE = [("Classification_TargetEnc", ["INCIDENT_CLASSIFICATION"]), ("DispatchArea_TargetEnc", ["INCIDENT_DISPATCH_AREA"]),
      ("Borough_TargetEnc", ["BOROUGH"])]
IA = [("Borough_Hour_Avg", ["BOROUGH", "Hour"]),
      ("Classification_Severity_Avg", ["INCIDENT_CLASSIFICATION", "INITIAL_SEVERITY_LEVEL_CODE"]),
      ("DispatchArea_Hour_Avg", ["INCIDENT_DISPATCH_AREA", "Hour"])]


def lookup_ctes(src: str, prefix: str) -> list[str]:
    """SQL lookups (global mean + six tables) fitted on ``src``."""
    ctes = [f"{prefix}_g AS (SELECT avg({TG}) AS g FROM {src})"]
    for name, keys in TE:
        k = ", ".join(keys)
        nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
        ctes.append(f"{prefix}_{name} AS (SELECT {k}, (count({TG}) * avg({TG}) + 20.0 * (SELECT g FROM {prefix}_g))"
                    f" / (count({TG}) + 20.0) AS {name} FROM {src} WHERE {nn} GROUP BY {k})")
    for name, keys in IA:
        k = ", ".join(keys)
        nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
        ctes.append(f"{prefix}_{name} AS (SELECT {k}, avg({TG}) AS {name} FROM {src} WHERE {nn} GROUP BY {k})")
    return ctes


def lookup_select(src: str, prefix: str, fallback_all: bool) -> str:
    cols, joins = [], []
    for name, keys in TE + IA:
        fb = fallback_all or name.endswith("TargetEnc")
        ref = f"{prefix}_{name}.{name}"
        cols.append(f"coalesce({ref}, (SELECT g FROM {prefix}_g)) AS {name}" if fb else f"{ref} AS {name}")
        on = " AND ".join(f"{prefix}_{name}.{k} = {src}.{k}" for k in keys)
        joins.append(f"LEFT JOIN {prefix}_{name} ON {on}")
    return ", ".join(cols), " ".join(joins)


_LK_COLS, _LK_JOINS = lookup_select("ev2", "lk", False)
ENH_CTE = (f"ev2 AS (SELECT *, {CYC_SQL}, {CTX_SQL} FROM ev),\n"
           f"enh AS (SELECT ev2.*, {_LK_COLS} FROM ev2 {_LK_JOINS})")
ENH_NUMERIC = MF_NUMERIC + CYC_COLS + [n for n, _ in IA] + CTX_COLS + [n for n, _ in TE]


@register("f8_f9_calendar_features", ev_sql(f"SELECT CAD_INCIDENT_ID, {CYC_SQL}, {CTX_SQL} FROM ev", CYC_COLS))
def q_calendar_features(spark, sf_dir):
    df = FE.with_calendar_features(events_clean(spark, sf_dir))
    return finalize(df.select(C.KEY, *CYC_COLS, *CTX_COLS))


@register("a8_target_encoding", ev_sql("SELECT CAD_INCIDENT_ID, " + ", ".join(n for n, _ in TE) + " FROM enh",
                                       [n for n, _ in TE], lookup_ctes("ev", "lk") + [ENH_CTE]))
def q_target_encoding(spark, sf_dir):
    df = FE.add_target_encoding(events_clean(spark, sf_dir))
    return finalize(df.select(C.KEY, *[n for n, _ in TE]))


@register("a9_interaction_features", ev_sql("SELECT CAD_INCIDENT_ID, " + ", ".join(n for n, _ in IA) + " FROM enh",
                                            [n for n, _ in IA], lookup_ctes("ev", "lk") + [ENH_CTE]))
def q_interaction_features(spark, sf_dir):
    df = FE.add_interaction_features(events_clean(spark, sf_dir))
    return finalize(df.select(C.KEY, *[n for n, _ in IA]))


def _long_sql(prefix: str) -> str:
    parts = []
    for name, keys in TE + IA:
        k2 = f"CAST({keys[1]} AS DOUBLE)" if len(keys) > 1 else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{name}' AS lookup, CAST({keys[0]} AS VARCHAR) AS key1, {k2} AS key2, {name} AS value "
                     f"FROM {prefix}_{name}")
    parts.append(f"SELECT '_global_mean', CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), g FROM {prefix}_g")
    return " UNION ALL ".join(parts)


@register("a10_interaction_lookup", ev_sql(_long_sql("lk"), ["key2", "value"], lookup_ctes("ev", "lk")))
def q_lookup(spark, sf_dir):
    return finalize(FE.fit_lookups(events_clean(spark, sf_dir)).long_form)


ENH_ALL = ENH_NUMERIC + MF_CATEGORICAL + [TG]


@register("p9_enhanced_model_frame", ev_sql(
    "SELECT CAD_INCIDENT_ID, " + ", ".join(ENH_ALL) + " FROM enh WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ENH_ALL),
    [c for c in ENH_ALL if c not in ("Hour", "DayOfWeek", "Month", "IsHeld", "IsReopen", "IsWeekend", "IsNight",
                                      "IsRushHour") and c not in MF_CATEGORICAL],
    lookup_ctes("ev", "lk") + [ENH_CTE]))
def q_enhanced_frame(spark, sf_dir):
    frame, _, _ = FE.make_enhanced_model_frame(events_clean(spark, sf_dir))
    return finalize(frame)


# --- evaluation with the lookup predictor (M9, P16, A19, A28–A32, A40–A42) ---
def key_hash_sql(col: str, seed: int) -> str:
    """``functions.scalars.key_hash`` in SQL."""
    k = f"((({col}) % {S.KEY_MODULUS} + {S.KEY_MODULUS}) % {S.KEY_MODULUS})"
    x = f"(({k} * {S.KEY_MULTIPLIER} + {seed * S.SEED_MULTIPLIER % S.HASH_MODULUS}) % {S.HASH_MODULUS})"
    for multiplier, shift in S.ROUND_MULTIPLIERS:
        x = f"(((xor({x}, {x} >> {shift}) & {S.KEY_MODULUS - 1}) * {multiplier}) % {S.HASH_MODULUS})"
    return f"xor({x}, {x} >> 16)"


def split_sql(src: str, seed: int = 0) -> str:
    return f"({key_hash_sql('CAD_INCIDENT_ID', seed)} // 65536) % 100 < 80"


EVAL_MODELS = {
    "Borough Hour Mean": ["BOROUGH", "Hour"],
    "Class Severity Mean": ["INCIDENT_CLASSIFICATION", "INITIAL_SEVERITY_LEVEL_CODE"],
}
EVAL_CONTEXT = ["BOROUGH", "INCIDENT_CLASSIFICATION", "Hour", "DayOfWeek"]


def eval_ctes(src: str = "ord") -> list[str]:
    ctes = [f"sp AS (SELECT *, {split_sql(src)} AS is_train FROM {src})",
            "tr AS (SELECT * FROM sp WHERE is_train)", "te AS (SELECT * FROM sp WHERE NOT is_train)",
            f"gtr AS (SELECT avg({TG}) AS g FROM tr)"]
    sel, joins = [], []
    for i, (name, keys) in enumerate(EVAL_MODELS.items()):
        k = ", ".join(keys)
        nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
        ctes.append(f"m{i} AS (SELECT {k}, avg({TG}) AS m FROM tr WHERE {nn} GROUP BY {k})")
        on = " AND ".join(f"m{i}.{x} = te.{x}" for x in keys)
        joins.append(f"LEFT JOIN m{i} ON {on}")
        sel.append(f"coalesce(m{i}.m, (SELECT g FROM gtr)) AS p{i}")
    ctes.append(f"scored AS (SELECT te.*, {', '.join(sel)} FROM te {' '.join(joins)})")
    pre = [E.model_prefix(n) for n in EVAL_MODELS]
    case_cols = ", ".join(f"p{i} AS {p}_Predicted_Minutes, p{i} - {TG} AS {p}_Error_Minutes" for i, p in enumerate(pre))
    ctes.append("cases AS (SELECT CAST(CAD_INCIDENT_ID AS VARCHAR) AS Case_Number, CAD_INCIDENT_ID, INCIDENT_DATETIME, "
                "FIRST_ON_SCENE_DATETIME, BOROUGH, INCIDENT_CLASSIFICATION, INCIDENT_DISPATCH_AREA, "
                f"INITIAL_SEVERITY_LEVEL_CODE, {TG} AS Actual_Response_Time_Minutes, {case_cols} FROM scored)")
    longs = " UNION ALL ".join(
        f"SELECT Case_Number, '{p}' AS model, Actual_Response_Time_Minutes AS actual, {p}_Predicted_Minutes AS predicted, "
        "BOROUGH, INCIDENT_CLASSIFICATION, INCIDENT_DISPATCH_AREA, INITIAL_SEVERITY_LEVEL_CODE, INCIDENT_DATETIME FROM cases"
        for p in pre)
    ctes.append(f"lp AS ({longs})")
    ctes.append("res AS (SELECT CAD_INCIDENT_ID, BOROUGH, INCIDENT_CLASSIFICATION, Hour, DayOfWeek, "
                f"{TG} AS Actual, p0 AS Predicted, {TG} - p0 AS Residual, abs({TG} - p0) AS Abs_Error FROM scored)")
    return ctes


def eval_sql(body: str, dbl: list[str], extra: list[str] | None = None) -> str:
    return ord_sql(body, dbl, eval_ctes() + (extra or []))


def _eval_models(train: DataFrame) -> dict:
    return {name: E.GroupMeanRegressor(keys).fit(train) for name, keys in EVAL_MODELS.items()}


def _eval_cases(spark, sf_dir) -> DataFrame:
    df = orders_clean(spark, sf_dir)
    train, test = E.train_test_split(df, min_rows=C.MIN_TRAINING_ROWS)
    return E.case_predictions(test, _eval_models(train), features=EVAL_CONTEXT)


def _eval_residuals(spark, sf_dir) -> DataFrame:
    df = orders_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    model = E.GroupMeanRegressor(EVAL_MODELS["Borough Hour Mean"]).fit(train)
    return E.residual_frame(model.transform(test), context=[C.KEY] + EVAL_CONTEXT)


@register("m9_train_test_split", ord_sql(f"""
SELECT CASE WHEN {split_sql('ord')} THEN 'train' ELSE 'test' END AS split, count(*) AS rows, avg({TG}) AS mean_minutes
FROM ord GROUP BY 1""", ["mean_minutes"]))
def q_split(spark, sf_dir):
    df = orders_clean(spark, sf_dir)
    lab = F.when(E.split_flag(), F.lit("train")).otherwise(F.lit("test"))
    return finalize(df.groupBy(lab.alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.avg(C.TARGET).alias("mean_minutes")))


CASE_DOUBLES = ["INITIAL_SEVERITY_LEVEL_CODE", "Actual_Response_Time_Minutes"] + [
    f"{E.model_prefix(n)}{suf}" for n in EVAL_MODELS for suf in ("_Predicted_Minutes", "_Error_Minutes")]


@register("p16_case_predictions", eval_sql("SELECT * FROM cases", CASE_DOUBLES))
def q_case_predictions(spark, sf_dir):
    return finalize(_eval_cases(spark, sf_dir))


@register("a19_model_quality", eval_sql("""
SELECT model, avg(abs(predicted - actual)) AS mae, median(abs(predicted - actual)) AS median_error,
  avg(CASE WHEN abs(predicted - actual) <= 5 THEN 1.0 ELSE 0.0 END) AS within_5,
  avg(CASE WHEN abs(predicted - actual) <= 10 THEN 1.0 ELSE 0.0 END) AS within_10,
  max(abs(predicted - actual)) AS max_error
FROM lp GROUP BY model""", ["mae", "median_error", "within_5", "within_10", "max_error"]))
def q_model_quality(spark, sf_dir):
    return finalize(E.model_quality(_eval_cases(spark, sf_dir)))


@register("a41_model_comparison", eval_sql("""
SELECT model AS Algorithm, avg(abs(predicted - actual)) AS MAE, sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE
FROM lp GROUP BY model""", ["MAE", "RMSE"]))
def q_comparison(spark, sf_dir):
    return finalize(E.comparison_table(_eval_cases(spark, sf_dir)))


@register("a42_best_model", eval_sql("""
SELECT model AS Algorithm, avg(abs(predicted - actual)) AS MAE, sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE
FROM lp GROUP BY model ORDER BY MAE, RMSE, Algorithm LIMIT 1""", ["MAE", "RMSE"]))
def q_best(spark, sf_dir):
    return finalize(E.best_model(E.comparison_table(_eval_cases(spark, sf_dir))))


@register("a40_metrics", eval_sql(f"""
SELECT avg(abs(p0 - {TG})) AS MAE, sqrt(avg((p0 - {TG}) * (p0 - {TG}))) AS RMSE FROM scored""", ["MAE", "RMSE"]))
def q_metrics(spark, sf_dir):
    df = orders_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    model = E.GroupMeanRegressor(EVAL_MODELS["Borough Hour Mean"]).fit(train)
    return finalize(E.regression_metrics(model.transform(test)))


RES_DOUBLES = ["Actual", "Predicted", "Residual", "Abs_Error"]


@register("p18_residuals", eval_sql("SELECT * FROM res", RES_DOUBLES))
def q_residuals(spark, sf_dir):
    return finalize(_eval_residuals(spark, sf_dir))


@register("a28_residual_kpis", eval_sql("""
SELECT avg(Abs_Error) AS mae,
  1.0 - sum(Residual * Residual) / sum((Actual - (SELECT avg(Actual) FROM res)) * (Actual - (SELECT avg(Actual) FROM res))) AS r2,
  max(Abs_Error) AS max_error, count(*) FILTER (WHERE Abs_Error > 15.0) AS large_errors,
  avg(CASE WHEN Abs_Error > 15.0 THEN 1.0 ELSE 0.0 END) AS large_error_share
FROM res""", ["mae", "r2", "max_error", "large_error_share"]))
def q_residual_kpis(spark, sf_dir):
    return finalize(E.residual_kpis(_eval_residuals(spark, sf_dir)))


@register("a29_residual_histogram", eval_sql(hist_sql("res", "Residual"), ["bin_start", "bin_end"]))
def q_residual_hist(spark, sf_dir):
    return finalize(R.histogram(_eval_residuals(spark, sf_dir), "Residual"))


@register("a30_mae_by_borough", eval_sql("SELECT BOROUGH, avg(Abs_Error) AS mae FROM res GROUP BY 1", ["mae"]))
def q_mae_borough(spark, sf_dir):
    return finalize(E.error_by(_eval_residuals(spark, sf_dir), "BOROUGH"))


@register("a31_mae_by_hour", eval_sql("SELECT Hour, avg(Abs_Error) AS mae FROM res GROUP BY 1", ["mae"]))
def q_mae_hour(spark, sf_dir):
    return finalize(E.error_by(_eval_residuals(spark, sf_dir), "Hour", order_by_error=False))


@register("a32_segmented_errors", eval_sql(" UNION ALL ".join(
    f"SELECT '{s}' AS segment, CAST({s} AS VARCHAR) AS segment_value, count(Abs_Error) AS cases, "
    "avg(Abs_Error) AS mean_error, max(Abs_Error) AS max_error, avg(Actual) AS mean_actual, "
    f"avg(Predicted) AS mean_predicted FROM res GROUP BY {s}" for s in EVAL_CONTEXT),
    ["mean_error", "max_error", "mean_actual", "mean_predicted"]))
def q_segmented(spark, sf_dir):
    return finalize(E.segmented_errors(_eval_residuals(spark, sf_dir)))


@register("o2_worst_cases", eval_sql("""
SELECT CAD_INCIDENT_ID, Actual, Predicted, Residual, Abs_Error, BOROUGH, INCIDENT_CLASSIFICATION, Hour
FROM res ORDER BY Abs_Error DESC, CAD_INCIDENT_ID LIMIT 20""", RES_DOUBLES))
def q_worst_cases(spark, sf_dir):
    return finalize(E.worst_cases(_eval_residuals(spark, sf_dir)))


@register("p14_large_errors", eval_sql("""
SELECT count(*) FILTER (WHERE Abs_Error > 15.0) AS large_errors,
  avg(CASE WHEN Abs_Error > 15.0 THEN 1.0 ELSE 0.0 END) AS large_error_share FROM res""", ["large_error_share"]))
def q_large_errors(spark, sf_dir):
    return finalize(E.residual_kpis(_eval_residuals(spark, sf_dir)).select("large_errors", "large_error_share"))


@register("p20_case_comparison", eval_sql("""
SELECT Case_Number, model, actual, predicted, predicted - actual AS delta, BOROUGH, INCIDENT_CLASSIFICATION,
  INCIDENT_DISPATCH_AREA, INITIAL_SEVERITY_LEVEL_CODE, INCIDENT_DATETIME FROM lp""",
    ["actual", "predicted", "delta", "INITIAL_SEVERITY_LEVEL_CODE"]))
def q_case_comparison(spark, sf_dir):
    return finalize(E.case_comparison(_eval_cases(spark, sf_dir)))


@register("m15_predict_cases", eval_sql("""
SELECT Case_Number, model, actual, predicted, predicted - actual AS error FROM lp""", ["actual", "predicted", "error"]))
def q_predict_cases(spark, sf_dir):
    df = orders_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    ids = test.select(F.col(C.KEY).cast("string").alias("case_id"))
    return finalize(E.predict_cases(df, ids, _eval_models(train), features=EVAL_CONTEXT))


@register("m19_partial_dependence_hour", eval_sql("""
SELECT r.h AS Hour, avg(coalesce(m0.m, (SELECT g FROM gtr))) AS partial_dependence
FROM te CROSS JOIN range(24) r(h) LEFT JOIN m0 ON m0.BOROUGH = te.BOROUGH AND m0.Hour = r.h
GROUP BY r.h""", ["partial_dependence"]))
def q_pdp(spark, sf_dir):
    df = orders_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    model = E.GroupMeanRegressor(EVAL_MODELS["Borough Hour Mean"]).fit(train)
    return finalize(X.partial_dependence(model, test, "Hour", list(range(24))))


# --- sources, samples, splits, payloads (S2, M10, M21, P17) -----------------
@register("s2_training_sample", ev_sql(
    "SELECT * FROM ev ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID LIMIT 5000", EV_DOUBLES))
def q_training_sample(spark, sf_dir):
    return finalize(SR.training_sample(FX.incidents_events(spark, sf_dir), 5000))


@register("m10_temporal_split", ord_sql(f"""
SELECT CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
  min(INCIDENT_DATETIME) AS first_time, max(INCIDENT_DATETIME) AS last_time
FROM (SELECT *, row_number() OVER (ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID) AS rn,
             floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS k FROM ord)
GROUP BY 1""", []))
def q_temporal_split(spark, sf_dir):
    df = orders_clean(spark, sf_dir)
    train, test = E.temporal_split(df)
    def side(d, name):
        return d.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("rows"),
                     F.min(C.INCIDENT_DATETIME).alias("first_time"), F.max(C.INCIDENT_DATETIME).alias("last_time"))
    return side(train, "train").unionByName(side(test, "test"))


@register("m21_seeded_sample", ord_sql(f"""
SELECT CAD_INCIDENT_ID, {TG} FROM ord ORDER BY {key_hash_sql('CAD_INCIDENT_ID', 42)}, CAD_INCIDENT_ID LIMIT 8000""",
    [TG]))
def q_seeded_sample(spark, sf_dir):
    return finalize(E.seeded_sample(orders_clean(spark, sf_dir), 8000).select(C.KEY, C.TARGET))


PAYLOAD_FEATURES = ENH_NUMERIC + MF_CATEGORICAL


def _p17_sql() -> str:
    ctes = [f"sp AS (SELECT *, {split_sql('ev')} AS is_train FROM ev)",
            "tr AS (SELECT * FROM sp WHERE is_train)",
            "te AS (SELECT CAD_INCIDENT_ID, " + ", ".join(C.PAYLOAD_COLUMNS) + " FROM sp WHERE NOT is_train)",
            f"pay AS (SELECT *, {CYC_SQL}, {CTX_SQL} FROM te)"] + lookup_ctes("tr", "pl")
    cols, joins = lookup_select("pay", "pl", True)
    body = (f"SELECT CAD_INCIDENT_ID, {cols}, " + ", ".join(
        [f"coalesce(TRY_CAST(pay.{c} AS DOUBLE), 0.0) AS {c}" for c in ENH_NUMERIC if c not in
         [n for n, _ in TE + IA]] + [f"trim(coalesce(CAST(pay.{c} AS VARCHAR), '')) AS {c}" for c in MF_CATEGORICAL])
        + f" FROM pay {joins}")
    return ev_sql(body, [c for c in ENH_NUMERIC], ctes)


@register("p17_prediction_input", _p17_sql())
def q_prediction_input(spark, sf_dir):
    df = events_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    lookups = FE.fit_lookups(train)
    payload = test.select(C.KEY, *C.PAYLOAD_COLUMNS)
    return finalize(FE.prediction_input(payload, lookups, PAYLOAD_FEATURES, MF_CATEGORICAL))


@register("m4_linear_one_feature", ord_sql(f"""
SELECT regr_slope({TG}, INITIAL_SEVERITY_LEVEL_CODE) AS slope, regr_intercept({TG}, INITIAL_SEVERITY_LEVEL_CODE) AS intercept
FROM ord""", ["slope", "intercept"]))
def q_linear_one_feature(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    df = orders_clean(spark, sf_dir)
    vec = VectorAssembler(inputCols=["INITIAL_SEVERITY_LEVEL_CODE"], outputCol=LN.FEATURES).transform(df)
    m = LN.linear().fit(vec)
    return finalize(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double"))


PAIR = ("BOROUGH", "Hour")


@register("m18_exact_shapley", eval_sql(f"""
SELECT CAD_INCIDENT_ID, feature, CASE feature WHEN 'BOROUGH' THEN (va - g + f - vb) / 2 ELSE (vb - g + f - va) / 2 END AS shapley_value
FROM (SELECT te.CAD_INCIDENT_ID, coalesce(p.f, gg.g) AS f, coalesce(a.v, gg.g) AS va, coalesce(b.v, gg.g) AS vb, gg.g
      FROM te CROSS JOIN (SELECT sum(s) / sum(n) AS g, sum(n) AS n FROM pairs) gg
      LEFT JOIN pairs p ON p.BOROUGH = te.BOROUGH AND p.Hour = te.Hour
      LEFT JOIN (SELECT x.BOROUGH, sum(coalesce(q.f, t.g) * w.n) / any_value(t.n) AS v
                 FROM (SELECT DISTINCT BOROUGH FROM pairs) x CROSS JOIN (SELECT Hour, sum(n) AS n FROM pairs GROUP BY 1) w
                 CROSS JOIN (SELECT sum(s) / sum(n) AS g, sum(n) AS n FROM pairs) t
                 LEFT JOIN pairs q ON q.BOROUGH = x.BOROUGH AND q.Hour = w.Hour GROUP BY 1) a ON a.BOROUGH = te.BOROUGH
      LEFT JOIN (SELECT x.Hour, sum(coalesce(q.f, t.g) * w.n) / any_value(t.n) AS v
                 FROM (SELECT DISTINCT Hour FROM pairs) x CROSS JOIN (SELECT BOROUGH, sum(n) AS n FROM pairs GROUP BY 1) w
                 CROSS JOIN (SELECT sum(s) / sum(n) AS g, sum(n) AS n FROM pairs) t
                 LEFT JOIN pairs q ON q.Hour = x.Hour AND q.BOROUGH = w.BOROUGH GROUP BY 1) b ON b.Hour = te.Hour),
     (SELECT unnest(['BOROUGH', 'Hour']) AS feature)""", ["shapley_value"],
    [f"pairs AS (SELECT BOROUGH, Hour, avg({TG}) AS f, count({TG}) AS n, sum({TG}) AS s FROM tr GROUP BY 1, 2)"]))
def q_exact_shapley(spark, sf_dir):
    train, test = E.train_test_split(orders_clean(spark, sf_dir))
    return finalize(X.exact_pair_shapley(train, test, *PAIR))


@register("m18_linear_shapley", eval_sql(f"""
SELECT te.CAD_INCIDENT_ID, 'INITIAL_SEVERITY_LEVEL_CODE' AS feature, m.slope * (te.INITIAL_SEVERITY_LEVEL_CODE - m.x) AS shapley_value
FROM te CROSS JOIN (SELECT regr_slope({TG}, INITIAL_SEVERITY_LEVEL_CODE) AS slope, avg(INITIAL_SEVERITY_LEVEL_CODE) AS x FROM tr) m""",
    ["shapley_value"]))
def q_linear_shapley(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    feature = "INITIAL_SEVERITY_LEVEL_CODE"
    train, test = E.train_test_split(orders_clean(spark, sf_dir))
    fitted = LN.linear().fit(VectorAssembler(inputCols=[feature], outputCol=LN.FEATURES).transform(train))
    mean = train.agg(F.avg(feature)).first()[0]
    return finalize(X.linear_shapley(test, {feature: float(fitted.coefficients[0])}, {feature: mean}))


LINEAR_PAIR = ("INITIAL_SEVERITY_LEVEL_CODE", "Hour")


@register("m18_kernel_shapley", eval_sql(f"""
SELECT te.CAD_INCIDENT_ID, f.feature, CASE f.feature WHEN 'Hour' THEN (m.bv * m.a2 - m.av * m.ab) / m.det * (te.Hour - m.b)
       ELSE (m.av * m.b2 - m.bv * m.ab) / m.det * (te.INITIAL_SEVERITY_LEVEL_CODE - m.a) END AS shapley_value
FROM te CROSS JOIN (SELECT *, a2 * b2 - ab * ab AS det FROM (
    SELECT avg(INITIAL_SEVERITY_LEVEL_CODE) AS a, avg(Hour) AS b, var_pop(INITIAL_SEVERITY_LEVEL_CODE) AS a2, var_pop(Hour) AS b2,
           covar_pop(INITIAL_SEVERITY_LEVEL_CODE, Hour) AS ab, covar_pop(INITIAL_SEVERITY_LEVEL_CODE, {TG}) AS av,
           covar_pop(Hour, {TG}) AS bv FROM tr)) m,
     (SELECT unnest(['INITIAL_SEVERITY_LEVEL_CODE', 'Hour']) AS feature) f""", ["shapley_value"]))
def q_kernel_shapley(spark, sf_dir):
    """Any-model attribution of a linear model of two features, against the training means: equals the closed form."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    train, test = E.train_test_split(orders_clean(spark, sf_dir))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(LINEAR_PAIR), outputCol=LN.FEATURES), LN.linear()]).fit(train)
    mean = train.agg(*[F.avg(f).alias(f) for f in LINEAR_PAIR])
    rows = test.select(C.KEY, *[F.col(f).cast("double").alias(f) for f in LINEAR_PAIR])
    return finalize(X.kernel_shapley(model, rows, mean, LINEAR_PAIR))


# --- inputs that the fixtures lack: date forms, repeated ids ------------------
@register("f1_parse_variants", """
SELECT event_id, CASE WHEN k IN (0, 1) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS dispatch_time,
  CASE k WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:00') END AS generic_time,
  CASE WHEN k = 1 THEN 'QUEENS' ELSE 'nan' END AS borough, CASE WHEN k = 1 THEN 1 ELSE 0 END AS held
FROM (SELECT event_id, event_id % 5 AS k, ts FROM events)""")
def q_parse_variants(spark, sf_dir):
    ts, k = F.col("ts").cast("timestamp_ntz"), F.col("event_id") % 5
    text = (F.when(k == 0, F.date_format(ts, "M/d/yyyy h:mm:ss a"))
            .when(k == 1, F.concat(F.lit("\t"), F.date_format(ts, "MM/dd/yyyy hh:mm:ss a"), F.lit(" \n")))
            .when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format(ts, "yyyy/MM/dd HH:mm"))
            .otherwise("unknown"))
    form = "yyyy-MM-dd HH:mm:ss"
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", text.alias("t"), F.when(k == 1, F.lit("\tQUEENS\n")).alias("b"), F.when(k == 1, F.lit("\ty\r")).alias("h"))
    return df.select("event_id", F.date_format(S.parse_text_datetime("t"), form).alias("dispatch_time"),
                     F.date_format(S.parse_generic_datetime("t"), form).alias("generic_time"),
                     S.as_text("b").alias("borough"), S.yes_flag("h").alias("held"))


#: Texts of seconds by row, as a query writes them over the events.
NUMBER_FORMS = ["nan", "NaN", "1d", "5f", "inf", " 90 ", "1e2", "-3", "", "n/a"]
NUMBER_SQL = """CASE k WHEN 4 THEN 'Infinity'::DOUBLE WHEN 5 THEN 90.0 WHEN 6 THEN 100.0 WHEN 7 THEN -3.0
  ELSE CASE WHEN k >= 10 THEN CAST(event_id % 700 AS DOUBLE) END END"""


@register("f6_number_variants", f"""
SELECT event_id, coalesce(least(greatest(CASE WHEN x = 'Infinity'::DOUBLE THEN 1e300 ELSE x END, 0.0), 600.0), 0.0) AS dispatch_seconds,
  CASE WHEN x < 1e300 THEN x END AS number, CASE WHEN k % 2 = 1 THEN 5.0 * k END AS from_double
FROM (SELECT event_id, k, {NUMBER_SQL} AS x FROM (SELECT event_id, event_id % 13 AS k FROM events))""")
def q_number_variants(spark, sf_dir):
    k = F.col("event_id") % 13
    text = F.coalesce(F.get(F.array(*map(F.lit, NUMBER_FORMS)), k.cast("int")), (F.col("event_id") % 700).cast("string"))
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", text.alias("t"), F.when(k % 2 == 1, 5.0 * k).otherwise(F.lit(float("nan"))).alias("d"))
    number = S.to_number("t")
    return df.select("event_id", S.dispatch_seconds("t").alias("dispatch_seconds"), F.when(number < 1e300, number).alias("number"),
                     S.to_number("d").alias("from_double"))


# --- roadmap joins (R1, R2) ---------------------------------------------------
@register("r1_last_known_hour", ev_sql("""
SELECT ev.CAD_INCIDENT_ID, coalesce(s.hour_incidents, -1) AS hour_incidents FROM ev ASOF LEFT JOIN side s
ON ev.BOROUGH = s.BOROUGH AND date_trunc('hour', ev.INCIDENT_DATETIME) >= s.hour""", [], ["""side AS (
SELECT BOROUGH, date_trunc('hour', INCIDENT_DATETIME) AS hour, count(*) AS hour_incidents FROM ev
WHERE BOROUGH IS NOT NULL AND (CAST(epoch(date_trunc('hour', INCIDENT_DATETIME)) AS BIGINT) // 3600) % 3 <> 2 GROUP BY 1, 2)"""]))
def q_last_known(spark, sf_dir):
    """Each incident with its borough's incidents of the latest hour that has a row (-1: none); every third hour has none."""
    df = events_clean(spark, sf_dir)
    hour = F.date_trunc("hour", C.INCIDENT_DATETIME).cast("timestamp_ntz")
    number = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), hour)
    side = df.where(F.col("BOROUGH").isNotNull() & (number % 3 != 2)).groupBy("BOROUGH", hour.alias("hour")) \
        .agg(F.count(F.lit(1)).alias("hour_incidents"))
    return TR.add_last_known(df, side, "BOROUGH", "hour_incidents") \
        .select(C.KEY, F.coalesce("hour_incidents", F.lit(-1)).alias("hour_incidents"))


#: Coordinates as functions of a key: two factors, modulo 100,000, over a box of 0.4 by 0.55 degrees.
def _place(k, a: int, b: int):
    return (F.lit(40.5) + (k * a % 100_000) * F.lit(0.000004)).alias("lat"), (F.lit(-74.25) + (k * b % 100_000) * F.lit(0.0000055)).alias("lon")


def _place_sql(k: str, a: int, b: int) -> str:
    return (f"40.5::DOUBLE + ({k} * {a} % 100000) * 0.000004::DOUBLE AS lat, "
            f"-74.25::DOUBLE + ({k} * {b} % 100000) * 0.0000055::DOUBLE AS lon")


@register("r2_nearest_station", O.rounded(f"""
SELECT CAD_INCIDENT_ID, station_id, distance_km FROM (
  SELECT i.id AS CAD_INCIDENT_ID, s.id AS station_id, round(2 * 6371.0088::DOUBLE * asin(least(1.0::DOUBLE, sqrt(
      pow(sin(radians(s.lat - i.lat) / 2), 2) + cos(radians(i.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - i.lon) / 2), 2)))), 6) AS distance_km
  FROM (SELECT event_id AS id, {_place_sql('event_id', 7919, 15_485_863)} FROM events WHERE event_id % 97 <> 0) i
  CROSS JOIN (SELECT s_suppkey AS id, {_place_sql('s_suppkey', 104_729, 32_452_843)} FROM supplier) s)
QUALIFY row_number() OVER (PARTITION BY CAD_INCIDENT_ID ORDER BY distance_km, station_id) = 1
UNION ALL SELECT event_id, -1, NULL FROM events WHERE event_id % 97 = 0""", ["distance_km"]))
def q_nearest(spark, sf_dir):
    """Stations from suppliers, incidents from events; every 97th incident has no place."""
    k = F.col("event_id")
    lat, lon = _place(k, 7919, 15_485_863)
    known = k % 97 != 0
    incidents = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias(C.KEY), F.when(known, lat).alias("lat"), F.when(known, lon).alias("lon"))
    stations = spark.read.parquet(f"{sf_dir}/supplier.parquet") \
        .select(F.col("s_suppkey").alias("station_id"), *_place(F.col("s_suppkey"), 104_729, 32_452_843))
    return finalize(TR.nearest_station(incidents, stations).withColumn("station_id", F.coalesce("station_id", F.lit(-1))))


def _doubled(spark, sf_dir) -> DataFrame:
    """Every incident twice: ids repeat."""
    df = orders_clean(spark, sf_dir)
    return df.unionByName(df)


DOUBLED = ["dbl AS (SELECT * FROM ord UNION ALL SELECT * FROM ord)"]


@register("m10_temporal_split_repeated_ids", ord_sql(f"""
SELECT CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS split, count(*) AS rows, avg({TG}) AS mean_minutes
FROM (SELECT *, row_number() OVER (ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID) AS rn,
             floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) AS k FROM dbl)
GROUP BY 1""", ["mean_minutes"], DOUBLED))
def q_temporal_split_repeated(spark, sf_dir):
    train, test = E.temporal_split(_doubled(spark, sf_dir))
    both = train.select(F.lit("train").alias("split"), C.TARGET).unionByName(test.select(F.lit("test").alias("split"), C.TARGET))
    return finalize(both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(C.TARGET).alias("mean_minutes")))


@register("s2_first_rows_repeated_ids", ord_sql(
    f"SELECT CAD_INCIDENT_ID, {TG} FROM dbl ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID LIMIT 1001", [TG], DOUBLED))
def q_first_rows_repeated(spark, sf_dir):
    from . import ordered
    return finalize(ordered.first_n_by(_doubled(spark, sf_dir), 1001, [C.INCIDENT_DATETIME, C.KEY]).select(C.KEY, C.TARGET))


@register("r6_area_last5_avg_repeated_ids", ord_sql(f"""
SELECT CAD_INCIDENT_ID, avg({TG}) OVER (PARTITION BY INCIDENT_DISPATCH_AREA ORDER BY INCIDENT_DATETIME, CAD_INCIDENT_ID
                                        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DispatchArea_Last5_Avg
FROM dbl""", ["DispatchArea_Last5_Avg"], DOUBLED))
def q_last5_repeated(spark, sf_dir):
    return finalize(TR.add_area_lastn_avg(_doubled(spark, sf_dir), 5).select(C.KEY, "DispatchArea_Last5_Avg"))


@register("a33_severity_by_borough_long", ord_sql(f"""
SELECT BOROUGH, INITIAL_SEVERITY_LEVEL_CODE, avg({TG}) AS mean_minutes FROM ord
WHERE INITIAL_SEVERITY_LEVEL_CODE IS NOT NULL GROUP BY 1, 2""", ["INITIAL_SEVERITY_LEVEL_CODE", "mean_minutes"]))
def q_severity_by_borough_long(spark, sf_dir):
    return finalize(R.severity_by_borough_long(orders_clean(spark, sf_dir)))


@register("m14_score_payloads_lookup", eval_sql("""
SELECT CAD_INCIDENT_ID AS payload_id, 'Borough Hour Mean' AS model, p0 AS predicted_minutes FROM scored
UNION ALL SELECT CAD_INCIDENT_ID, 'Class Severity Mean', p1 FROM scored""", ["predicted_minutes"]))
def q_score_payloads_lookup(spark, sf_dir):
    train, test = E.train_test_split(orders_clean(spark, sf_dir))
    return finalize(LN.score_payloads(test.withColumnRenamed(C.KEY, "payload_id"), _eval_models(train)))


@register("m1_standardised_features", ord_sql(f"""
SELECT CAD_INCIDENT_ID, (Hour - mh) / sh AS z_hour, (INITIAL_SEVERITY_LEVEL_CODE - ms) / ss AS z_severity
FROM ord CROSS JOIN (SELECT avg(Hour) mh, stddev_samp(Hour) sh, avg(INITIAL_SEVERITY_LEVEL_CODE) ms,
                            stddev_samp(INITIAL_SEVERITY_LEVEL_CODE) ss FROM ord)""", ["z_hour", "z_severity"]))
def q_standardised(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    df = orders_clean(spark, sf_dir)
    pre = LN.Preprocessor(["Hour", "INITIAL_SEVERITY_LEVEL_CODE"], []).fit(df)
    z = vector_to_array(F.col(LN.FEATURES))
    return finalize(pre.transform(df).select(C.KEY, z[0].alias("z_hour"), z[1].alias("z_severity")))


@register("m2_one_hot", ord_sql("""
SELECT CAD_INCIDENT_ID, f.feature FROM ord CROSS JOIN (SELECT min(BOROUGH) AS b, min(INCIDENT_DISPATCH_AREA) AS c FROM ord) m,
LATERAL (SELECT 'BOROUGH_' || BOROUGH AS feature WHERE BOROUGH <> m.b
         UNION ALL SELECT 'INCIDENT_DISPATCH_AREA_' || INCIDENT_DISPATCH_AREA WHERE INCIDENT_DISPATCH_AREA <> m.c) f""", []))
def q_one_hot(spark, sf_dir):
    """The ones of every row's encoded vector, by feature name; the first level of a column has none."""
    from pyspark.ml.functions import vector_to_array
    df = orders_clean(spark, sf_dir)
    pre = LN.Preprocessor([], ["BOROUGH", "INCIDENT_DISPATCH_AREA"]).fit(df)
    names = F.array(*map(F.lit, pre.feature_names))
    ones = F.filter(F.arrays_zip(names.alias("feature"), vector_to_array(LN.FEATURES).alias("one")), lambda x: x["one"] == 1.0)
    return pre.transform(df).select(C.KEY, F.inline(ones)).drop("one")


# --- inputs with other headers, several inputs, names --------------------------
@register("p1_other_headers", ev_sql("SELECT * FROM ev", EV_DOUBLES))
def q_other_headers(spark, sf_dir):
    """Headers in small letters, with blanks around and blanks or hyphens inside: the same clean table."""
    raw = FX.incidents_events(spark, sf_dir)
    return finalize(CL.clean_incidents(raw.toDF(*[f" {c.lower().replace('_', ' -'[i % 2])}\t" for i, c in enumerate(raw.columns)])))


@register("u1_union_inputs", """
SELECT c_custkey AS id, c_name AS name, floor(c_acctbal * 100 + 0.5) AS cents, NULL::DOUBLE AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS DOUBLE) FROM supplier""")
def q_union_inputs(spark, sf_dir):
    """Inputs of different columns, repeated rows kept: what one lacks is null."""
    customers = FX.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.floor(F.col("c_acctbal") * 100 + 0.5).cast("double").alias("cents"))
    suppliers = FX.read_table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("nation"))
    return SR.union_inputs([customers, suppliers])


@register("f16_slugs", "SELECT p_partkey, translate(lower(p_type || ' - ' || p_name), ' -', '__') AS slug FROM part")
def q_slugs(spark, sf_dir):
    return FX.read_table(spark, sf_dir, "part").select(
        "p_partkey", S.slugify(F.concat_ws(" - ", "p_type", "p_name")).alias("slug"))


# --- trained learners (rows-only checks) -------------------------------------
def _ml_setup(spark, sf_dir):
    frame, num, cat = CL.make_model_frame(orders_clean(spark, sf_dir))
    train, test = E.train_test_split(frame, min_rows=C.MIN_TRAINING_ROWS)
    return train, test, num, cat


def _learner_cases(spark, sf_dir, name: str) -> DataFrame:
    train, test, num, cat = _ml_setup(spark, sf_dir)
    models = LN.fit_models(train, num, cat, LN.make_models(names=[name]))
    return finalize(E.case_predictions(test, models, features=num + cat))


@register("m4_linear_regression")
def q_linear(spark, sf_dir):
    return _learner_cases(spark, sf_dir, C.MODEL_NAMES[0])


@register("m20_cluster_profile")
def q_clusters(spark, sf_dir):
    return finalize(LN.cluster_profile(orders_clean(spark, sf_dir), k=5))


@register("m14_score_payloads")
def q_score_payloads(spark, sf_dir):
    df = events_clean(spark, sf_dir)
    train, test = E.train_test_split(df)
    lookups = FE.fit_lookups(train)
    frame, num, cat = FE.make_enhanced_model_frame(train, lookups)
    models = LN.fit_models(frame, num, cat, LN.make_models(names=[C.MODEL_NAMES[0]]))
    payload = test.select(F.col(C.KEY).alias("payload_id"), *C.PAYLOAD_COLUMNS)
    inputs = FE.prediction_input(payload, lookups, num + cat, cat)
    return finalize(LN.score_payloads(inputs, models))


def _shapley(spark, sf_dir) -> DataFrame:
    """All rows of the hold-out; draws and background are parameters of the estimator."""
    train, test, num, cat = _ml_setup(spark, sf_dir)
    models = LN.fit_models(train, num, cat, LN.make_models(names=[C.MODEL_NAMES[0]]))
    return X.sampled_shapley(models[C.MODEL_NAMES[0]], test, train, num + cat, draws=16, background_rows=50)


@register("m18_shapley_values")
def q_shapley(spark, sf_dir):
    return finalize(_shapley(spark, sf_dir))


@register("a43_attribution_summary")
def q_attribution(spark, sf_dir):
    return finalize(X.attribution_summary(_shapley(spark, sf_dir)))


@register("m18_tree_shapley")
def q_tree_shapley(spark, sf_dir):
    """Exact values of all hold-out rows for boosted trees of 30 rounds (settings A otherwise)."""
    train, test, num, cat = _ml_setup(spark, sf_dir)
    config = dataclasses.replace(LN.BOOST_A, max_iter=30)
    model = LN.fit_models(train, num, cat, {"m": LN.boosted(config)})["m"]
    return finalize(X.tree_shapley(model, test))


@register("r11_propensity_att")
def q_propensity(spark, sf_dir):
    frame, num, cat = CL.make_model_frame(orders_clean(spark, sf_dir))
    strata = CA.propensity_strata(frame, "BOROUGH", DID_TREATED, num, cat)
    return finalize(CA.att_from_strata(strata))


@register("r9_importance_by_borough")
def q_importance_by_borough(spark, sf_dir):
    frame, num, cat = CL.make_model_frame(orders_clean(spark, sf_dir))
    return finalize(LN.segment_importance(frame, num, cat, "BOROUGH"))


@register("m5_random_forest")
def q_forest(spark, sf_dir):
    return _learner_cases(spark, sf_dir, C.MODEL_NAMES[1])


@register("m16_feature_importance")
def q_importance(spark, sf_dir):
    train, test, num, cat = _ml_setup(spark, sf_dir)
    models = LN.fit_models(train, num, cat, LN.make_models(names=[C.MODEL_NAMES[1]]))
    return finalize(LN.feature_importance(models[C.MODEL_NAMES[1]], 20))


STUMP = "INITIAL_SEVERITY_LEVEL_CODE"


@register("m6_boosted_stump", ord_sql(f"""
SELECT side, threshold, rows, CASE WHEN side = 'left' THEN gl / (hl + 1) ELSE (g - gl) / (h - hl + 1) END AS leaf_value
FROM (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) AS gain FROM
  (SELECT threshold, sum(s) OVER w AS gl, sum(n) OVER w AS hl, sum(s) OVER () AS g, sum(n) OVER () AS h
   FROM (SELECT {STUMP} AS threshold, sum({TG} - m) AS s, count(*) AS n
         FROM ord CROSS JOIN (SELECT avg({TG}) AS m FROM ord) GROUP BY 1) WINDOW w AS (ORDER BY threshold))
  WHERE hl < h ORDER BY gain DESC, threshold LIMIT 1)
CROSS JOIN LATERAL (SELECT unnest(['left', 'right']) AS side, unnest([CAST(hl AS BIGINT), CAST(h - hl AS BIGINT)]) AS rows)""",
    ["threshold", "leaf_value"]))
def q_stump(spark, sf_dir):
    """One round, one level, full step: the second-order split and its leaf values."""
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=[STUMP], outputCol=LN.FEATURES).transform(orders_clean(spark, sf_dir))
    model = LN.boosted(LN.BoostConfig(max_iter=1, max_depth=1, step_size=1.0)).fit(vec.select(C.KEY, LN.FEATURES, C.TARGET))
    tree = model.trees[0]
    rows = [(side, float(model.edges[0][tree.bin[0]]), tree.rows[k], tree.value[k])
            for side, k in (("left", tree.left[0]), ("right", tree.right[0]))]
    return finalize(spark.createDataFrame(rows, "side string, threshold double, rows long, leaf_value double"))


@register("m6_boosted_trees_a")
def q_boost_a(spark, sf_dir):
    return _learner_cases(spark, sf_dir, C.MODEL_NAMES[2])


@register("m7_boosted_trees_b")
def q_boost_b(spark, sf_dir):
    return _learner_cases(spark, sf_dir, C.MODEL_NAMES[3])


@register("m8_stacking_ensemble")
def q_stacking(spark, sf_dir):
    return _learner_cases(spark, sf_dir, C.MODEL_NAMES[4])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_borough_summary(spark, sf_dir)
