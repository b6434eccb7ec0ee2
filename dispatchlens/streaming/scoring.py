"""Structured Streaming forms of the per-row operators.

The reference has no streaming code; what it does per incident is stateless
given fitted lookups (clean -> F8/F9 -> six lookups -> model).  These helpers
run exactly those operators on a stream:

* ``read_incident_stream``: file-source stream (Parquet or CSV) with an explicit
  schema, a bounded number of files per micro-batch;
* ``score_stream``: clean + features + stream-static joins to the fitted lookup
  tables (broadcast only under their measured size) + optional model;
* ``borough_kpi_stream``: event-time windows per borough with a watermark, so
  state for old windows is dropped and late rows within the watermark count.

Cleaning in a stream cannot run the data probe (an action), so the dispatch
format is used as is (``datetime_fallback="never"``) unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators.clean import clean_incidents
from ..operators.features import Lookups, with_calendar_features
from ..operators.reports import slow_share


def read_incident_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                         max_files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def score_stream(stream: DataFrame, lookups: Lookups, model=None,
                 datetime_fallback: str = "never") -> DataFrame:
    """Clean, derive features and attach the fitted lookups to every incident."""
    clean = clean_incidents(stream, datetime_fallback=datetime_fallback)
    out = with_calendar_features(clean)
    for name in lookups.tables:
        out = lookups.join(out, name, fallback=True)
    return model.transform(out) if model is not None else out


def borough_kpi_stream(clean: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Per borough and event-time window: count, mean minutes, slow share."""
    ts = F.col(C.INCIDENT_DATETIME).cast("timestamp")
    t = F.col(C.TARGET)
    return (clean.withColumn("_event_time", ts)
                 .withWatermark("_event_time", watermark)
                 .groupBy(F.window("_event_time", window).alias("window"), "BOROUGH")
                 .agg(F.count(t).alias("cases"), F.avg(t).alias("mean_minutes"),
                      slow_share().alias("slow_share")))
