"""DuckDB reference SQL for the registered queries.

Each statement rebuilds the incident views from the base tables the checker
registers (``events``, ``orders``, ``customer``, ``nation``, ``region``), cleans
them with the same rules as ``operators.clean`` and computes the report.  Double
columns are rounded with ``floor(x * 1e4 + 0.5) / 1e4`` on both sides, because
the two engines sum in different orders.
"""

from __future__ import annotations

# Fixture views, DuckDB dialect (X6 as specified; X7 plus FIRST_ON_SCENE_DATETIME).
X6 = """incidents_events AS (
SELECT e.event_id AS CAD_INCIDENT_ID,
  CASE WHEN e.k = 42 THEN 'unknown' ELSE strftime(e.ts, '%m/%d/%Y %I:%M:%S %p') END AS INCIDENT_DATETIME,
  strftime(e.ts + to_seconds(CAST(e.rs AS INT)), '%m/%d/%Y %I:%M:%S %p') AS FIRST_ON_SCENE_DATETIME,
  CASE WHEN e.k = 99 THEN NULL ELSE r.r_name END AS BOROUGH,
  n.n_name AS INCIDENT_DISPATCH_AREA,
  upper(e.event_type) AS INITIAL_CALL_TYPE,
  CASE WHEN e.k % 13 = 5 THEN NULL ELSE upper(e.event_type) END AS FINAL_CALL_TYPE,
  CAST(1 + e.k % 8 AS DOUBLE) AS INITIAL_SEVERITY_LEVEL_CODE,
  CAST(1 + (e.k + e.event_id) % 8 AS DOUBLE) AS FINAL_SEVERITY_LEVEL_CODE,
  CASE WHEN e.k = 11 THEN 'n/a' ELSE CAST(e.k * 9 AS VARCHAR) END AS DISPATCH_RESPONSE_SECONDS_QY,
  CASE WHEN e.k % 17 = 3 THEN NULL ELSE CAST(e.rs AS DOUBLE) END AS INCIDENT_RESPONSE_SECONDS_QY,
  CASE WHEN e.k % 20 = 7 THEN 'n' ELSE 'y' END AS VALID_INCIDENT_RSPNS_TIME_INDC,
  CASE WHEN e.k % 10 = 0 THEN ' y' ELSE 'N' END AS HELD_INDICATOR,
  CASE WHEN e.k % 25 = 0 THEN 'Y' ELSE 'N' END AS REOPEN_INDICATOR,
  CASE WHEN e.user_id % 30 = 0 THEN NULL ELSE CAST(11200 + e.user_id % 50 AS DOUBLE) END AS ZIPCODE
FROM (SELECT *, k * 9 + CAST(floor(value * 10) AS BIGINT) AS rs
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)) e
JOIN nation n ON n.n_nationkey = e.user_id % 25
JOIN region r ON r.r_regionkey = n.n_regionkey)"""

X7 = """incidents_orders_base AS (
SELECT o.o_orderkey AS CAD_INCIDENT_ID,
  o.o_orderdate + to_minutes(CAST((o.o_orderkey * 7919) % 1440 AS INT)) AS INCIDENT_DATETIME,
  r.r_name AS BOROUGH, n.n_name AS INCIDENT_DISPATCH_AREA,
  c.c_mktsegment AS INCIDENT_CLASSIFICATION,
  CAST(substr(o.o_orderpriority, 1, 1) AS DOUBLE) AS INITIAL_SEVERITY_LEVEL_CODE,
  CASE WHEN o.o_orderstatus = 'P' THEN 'Y' ELSE 'N' END AS HELD_INDICATOR,
  CAST(CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) * 90
       + CASE WHEN ((o.o_orderkey * 7919) % 1440) BETWEEN 420 AND 599
               OR ((o.o_orderkey * 7919) % 1440) BETWEEN 1020 AND 1199 THEN 240 ELSE 0 END
       + CAST(floor(o.o_totalprice) AS BIGINT) % 1500 AS DOUBLE) AS INCIDENT_RESPONSE_SECONDS_QY
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey),
incidents_orders AS (
SELECT CAD_INCIDENT_ID, INCIDENT_DATETIME,
  INCIDENT_DATETIME + to_seconds(CAST(INCIDENT_RESPONSE_SECONDS_QY AS INT)) AS FIRST_ON_SCENE_DATETIME,
  BOROUGH, INCIDENT_DISPATCH_AREA, INCIDENT_CLASSIFICATION, INITIAL_SEVERITY_LEVEL_CODE,
  HELD_INDICATOR, INCIDENT_RESPONSE_SECONDS_QY
FROM incidents_orders_base)"""

_FMT = "'%m/%d/%Y %I:%M:%S %p'"


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def _txt(c: str) -> str:
    return f"trim(coalesce(CAST({c} AS VARCHAR), 'nan'), {_WS})"


def _flag(c: str) -> str:
    return f"CAST(coalesce(upper(trim(CAST({c} AS VARCHAR), {_WS})) = 'Y', false) AS INTEGER)"


_DERIVED = """, Response_Time_Minutes,
  CAST(hour(INCIDENT_DATETIME) AS INTEGER) AS Hour,
  CAST(isodow(INCIDENT_DATETIME) - 1 AS INTEGER) AS DayOfWeek,
  CAST(month(INCIDENT_DATETIME) AS INTEGER) AS Month"""

_KEEP = """WHERE INCIDENT_DATETIME IS NOT NULL AND FIRST_ON_SCENE_DATETIME IS NOT NULL
  AND BOROUGH IS NOT NULL AND Response_Time_Minutes IS NOT NULL
  AND Response_Time_Minutes BETWEEN 0.5 AND 60"""

CLEAN_EV = f"""ev_parsed AS (
SELECT * REPLACE (
    CAST(try_strptime(INCIDENT_DATETIME, {_FMT}) AS TIMESTAMP) AS INCIDENT_DATETIME,
    CAST(try_strptime(FIRST_ON_SCENE_DATETIME, {_FMT}) AS TIMESTAMP) AS FIRST_ON_SCENE_DATETIME)
FROM incidents_events),
ev_target AS (
SELECT *, FINAL_CALL_TYPE AS INCIDENT_CLASSIFICATION,
  coalesce(CASE WHEN upper(VALID_INCIDENT_RSPNS_TIME_INDC) = 'Y'
                THEN TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) / 60.0 END,
           date_diff('microsecond', INCIDENT_DATETIME, FIRST_ON_SCENE_DATETIME) / 60000000.0) AS Response_Time_Minutes
FROM ev_parsed),
ev AS (
SELECT CAD_INCIDENT_ID, INCIDENT_DATETIME, FIRST_ON_SCENE_DATETIME,
  {_txt('BOROUGH')} AS BOROUGH, {_txt('INCIDENT_DISPATCH_AREA')} AS INCIDENT_DISPATCH_AREA,
  INITIAL_CALL_TYPE, FINAL_CALL_TYPE, INITIAL_SEVERITY_LEVEL_CODE, FINAL_SEVERITY_LEVEL_CODE,
  least(greatest(coalesce(TRY_CAST(DISPATCH_RESPONSE_SECONDS_QY AS DOUBLE), 0.0), 0.0), 600.0) AS DISPATCH_RESPONSE_SECONDS_QY,
  INCIDENT_RESPONSE_SECONDS_QY, VALID_INCIDENT_RSPNS_TIME_INDC, HELD_INDICATOR, REOPEN_INDICATOR,
  {_txt('ZIPCODE')} AS ZIPCODE, {_txt('INCIDENT_CLASSIFICATION')} AS INCIDENT_CLASSIFICATION{_DERIVED},
  {_flag('HELD_INDICATOR')} AS IsHeld, {_flag('REOPEN_INDICATOR')} AS IsReopen
FROM ev_target
{_KEEP})"""

CLEAN_ORD = f"""ord_target AS (
SELECT *, coalesce(TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) / 60.0,
           date_diff('microsecond', INCIDENT_DATETIME, FIRST_ON_SCENE_DATETIME) / 60000000.0) AS Response_Time_Minutes
FROM incidents_orders),
ord AS (
SELECT CAD_INCIDENT_ID, INCIDENT_DATETIME, FIRST_ON_SCENE_DATETIME,
  {_txt('BOROUGH')} AS BOROUGH, {_txt('INCIDENT_DISPATCH_AREA')} AS INCIDENT_DISPATCH_AREA,
  {_txt('INCIDENT_CLASSIFICATION')} AS INCIDENT_CLASSIFICATION,
  INITIAL_SEVERITY_LEVEL_CODE, HELD_INDICATOR, INCIDENT_RESPONSE_SECONDS_QY{_DERIVED},
  {_flag('HELD_INDICATOR')} AS IsHeld, 0 AS IsReopen
FROM ord_target
{_KEEP})"""

EV = [X6, CLEAN_EV]
ORD = [X7, CLEAN_ORD]


def r(expr: str, digits: int = 4) -> str:
    """Same rounding formula as ``functions.scalars.round_half_up``."""
    scale = f"{10 ** digits}.0"
    v = f"(({expr}) * {scale})"
    return f"floor({v} + 0.5 + abs({v}) * 1e-9) / {scale}"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rounded(select_sql: str, double_cols: list[str], digits: int = 4) -> str:
    """Wrap a query so its double columns get the shared rounding."""
    if not double_cols:
        return select_sql
    repl = ", ".join(f"{r(c, digits)} AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{select_sql}\n) q"
