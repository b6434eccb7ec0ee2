"""Incident views derived from the driver's TPC-H-ish tables.

* ``incidents_events`` (X6): one dirty, text-typed incident per ``events`` row,
  with every cleaning branch represented (unparseable stamps, null boroughs,
  junk numerics, invalid flags, out-of-range targets).
* ``incidents_orders`` (X7): one typed, multi-year incident per ``orders`` row.
  It also carries ``FIRST_ON_SCENE_DATETIME`` (incident time plus the response
  seconds) so that it is a complete raw incident table for the cleaning step.

Both are plain joins of a large fact table with small dimension tables; the
dimension sides are small parquet files, so Spark's own size-checked broadcast
(``autoBroadcastJoinThreshold``) picks a broadcast hash join and falls back to a
shuffle join if a dimension ever grows past the threshold.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table.  The DataFrame (file listing and footer schema)
    is memoised per session: it is immutable and lazy, so queries share it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    per_session = _TABLES.setdefault(spark, {})
    if path not in per_session:
        per_session[path] = spark.read.parquet(path)
    return per_session[path]


def _fmt(ts):
    return F.date_format(ts, C.DATETIME_TEXT_FORMAT)


def incidents_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty text incidents built from ``events ⋈ nation ⋈ region``."""
    ev = read_table(spark, sf_dir, "events")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    k = F.get_json_object("props", "$.k").cast("long")
    e = (ev.withColumn("k", k)
           .withColumn("rs", F.col("k") * 9 + F.floor(F.col("value") * 10).cast("long"))
           .withColumn("nkey", F.pmod(F.col("user_id"), F.lit(25))))
    j = (e.join(nation, e["nkey"] == nation["n_nationkey"])
          .join(region, nation["n_regionkey"] == region["r_regionkey"]))
    kc = F.col("k")
    return j.select(
        F.col("event_id").alias("CAD_INCIDENT_ID"),
        F.when(kc == 42, F.lit("unknown")).otherwise(_fmt(F.col("ts"))).alias("INCIDENT_DATETIME"),
        _fmt(F.timestamp_add("SECOND", F.col("rs").cast("int"), F.col("ts"))).alias("FIRST_ON_SCENE_DATETIME"),
        F.when(kc == 99, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("BOROUGH"),
        F.col("n_name").alias("INCIDENT_DISPATCH_AREA"),
        F.upper("event_type").alias("INITIAL_CALL_TYPE"),
        F.when(kc % 13 == 5, F.lit(None).cast("string")).otherwise(F.upper("event_type")).alias("FINAL_CALL_TYPE"),
        (F.lit(1) + kc % 8).cast("double").alias("INITIAL_SEVERITY_LEVEL_CODE"),
        (F.lit(1) + (kc + F.col("event_id")) % 8).cast("double").alias("FINAL_SEVERITY_LEVEL_CODE"),
        F.when(kc == 11, F.lit("n/a")).otherwise((kc * 9).cast("string")).alias("DISPATCH_RESPONSE_SECONDS_QY"),
        F.when(kc % 17 == 3, F.lit(None).cast("double")).otherwise(F.col("rs").cast("double")).alias("INCIDENT_RESPONSE_SECONDS_QY"),
        F.when(kc % 20 == 7, F.lit("n")).otherwise(F.lit("y")).alias("VALID_INCIDENT_RSPNS_TIME_INDC"),
        F.when(kc % 10 == 0, F.lit(" y")).otherwise(F.lit("N")).alias("HELD_INDICATOR"),
        F.when(kc % 25 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("REOPEN_INDICATOR"),
        F.when(F.col("user_id") % 30 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(11200) + F.col("user_id") % 50).cast("double")).alias("ZIPCODE"),
    )


def incidents_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed multi-year incidents built from ``orders ⋈ customer ⋈ nation ⋈ region``."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    minute = (F.col("o_orderkey") * 7919) % 1440
    severity = F.substring("o_orderpriority", 1, 1)
    rush = (minute.between(420, 599) | minute.between(1020, 1199))
    seconds = (severity.cast("long") * 90
               + F.when(rush, F.lit(240)).otherwise(F.lit(0))
               + F.floor("o_totalprice").cast("long") % 1500).cast("double")
    j = (orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
               .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
               .join(region, nation["n_regionkey"] == region["r_regionkey"]))
    start = F.timestamp_add("MINUTE", minute.cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    return j.select(
        F.col("o_orderkey").alias("CAD_INCIDENT_ID"),
        start.alias("INCIDENT_DATETIME"),
        F.timestamp_add("SECOND", seconds.cast("int"), start).alias("FIRST_ON_SCENE_DATETIME"),
        F.col("r_name").alias("BOROUGH"),
        F.col("n_name").alias("INCIDENT_DISPATCH_AREA"),
        F.col("c_mktsegment").alias("INCIDENT_CLASSIFICATION"),
        severity.cast("double").alias("INITIAL_SEVERITY_LEVEL_CODE"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Y")).otherwise(F.lit("N")).alias("HELD_INDICATOR"),
        seconds.alias("INCIDENT_RESPONSE_SECONDS_QY"),
    )
