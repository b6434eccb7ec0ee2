"""Trend and comparison operators from the documented roadmap.

* ``add_borough_prev7d_avg`` (R5): the window runs over the *daily aggregate*
  per borough (one row per borough and day), never over the raw rows, so a
  borough holding a third of all incidents still yields a partition of only a
  few thousand day rows.  The rolled-up table is joined back with a
  size-checked broadcast.
* The others are single grouped aggregations with map-side combining.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..plans.joins import broadcast_if_small, materialize
from ..plans.ordered import last_known, running_sum

# Default fixed-date holidays as (month, day).
DEFAULT_HOLIDAYS = [(1, 1), (7, 4), (12, 25)]


def _t():
    return F.col(C.TARGET)


def add_holiday_flag(df: DataFrame, holidays: Sequence[tuple[int, int]] = DEFAULT_HOLIDAYS,
                     time_col: str = C.INCIDENT_DATETIME) -> DataFrame:
    """``IsHoliday`` = 1 when the incident date is one of the given (month, day)."""
    ts = F.col(time_col)
    hit = None
    for m, d in holidays:
        c = (F.month(ts) == F.lit(m)) & (F.dayofmonth(ts) == F.lit(d))
        hit = c if hit is None else hit | c
    return df.withColumn("IsHoliday", F.coalesce(hit.cast("int"), F.lit(0)))


def holiday_comparison(df: DataFrame, holidays: Sequence[tuple[int, int]] = DEFAULT_HOLIDAYS) -> DataFrame:
    """R4 report: mean and count on holidays versus other days."""
    return (add_holiday_flag(df, holidays).groupBy("IsHoliday")
            .agg(F.avg(_t()).alias("mean_minutes"), F.count(_t()).alias("cases")).orderBy("IsHoliday"))


def add_borough_prev7d_avg(df: DataFrame, days: int = 7, time_col: str = C.INCIDENT_DATETIME) -> DataFrame:
    """Mean target of the same borough over the ``days`` calendar days
    before the incident's date (the incident's own day excluded); null when
    there is no earlier incident in that range."""
    day = F.to_date(F.col(time_col))
    daily = (df.where(_t().isNotNull()).groupBy("BOROUGH", day.alias("_day"))
               .agg(F.sum(_t()).alias("_s"), F.count(_t()).alias("_n")))
    w = Window.partitionBy("BOROUGH").orderBy(F.unix_date("_day")).rangeBetween(-days, -1)
    roll = daily.select("BOROUGH", "_day",
                        (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("Borough_Prev7d_Avg"))
    roll = materialize(roll)
    return (df.withColumn("_day", day)
              .join(broadcast_if_small(roll), ["BOROUGH", "_day"], "left").drop("_day"))


def worst_segments(df: DataFrame, keys: Sequence[str] = ("BOROUGH", "Hour"), k: int = 5) -> DataFrame:
    """The k key combinations with the highest mean target."""
    return (df.groupBy(*keys).agg(F.avg(_t()).alias("mean_minutes"), F.count(_t()).alias("cases"))
              .orderBy(F.col("mean_minutes").desc(), *keys).limit(k))


def monthly_trend_by(df: DataFrame, key: str = "BOROUGH", time_col: str = C.INCIDENT_DATETIME) -> DataFrame:
    """Mean and count per key and calendar month (yyyy-MM)."""
    month = F.date_format(F.col(time_col), "yyyy-MM")
    return (df.groupBy(key, month.alias("year_month"))
              .agg(F.avg(_t()).alias("mean_minutes"), F.count(_t()).alias("cases"))
              .orderBy(key, "year_month"))


def difference_in_differences(df: DataFrame, group_col: str, treated: Sequence[str], cut,
                              time_col: str = C.INCIDENT_DATETIME) -> DataFrame:
    """2x2 means (treated/control x before/after ``cut``) and the
    difference-in-differences, in one aggregation pass."""
    tr = F.col(group_col).isin(list(treated))
    after = F.col(time_col) >= (cut if hasattr(cut, "alias") else F.lit(cut))

    def cell(a, b):
        return F.avg(F.when(a & b, _t()))

    agg = df.agg(cell(tr, ~after).alias("treated_before"), cell(tr, after).alias("treated_after"),
                 cell(~tr, ~after).alias("control_before"), cell(~tr, after).alias("control_after"))
    return agg.withColumn("did", (F.col("treated_after") - F.col("treated_before"))
                          - (F.col("control_after") - F.col("control_before")))


def add_area_lastn_avg(df: DataFrame, n: int = 5, key: str = "INCIDENT_DISPATCH_AREA",
                       time_col: str = C.INCIDENT_DATETIME, id_col: str = C.KEY) -> DataFrame:
    """Mean target of the ``n`` previous incidents (by time, then id) of the
    same dispatch area; null for an area's first incident.

    Skew-proof: the exact rank inside each area comes from ``running_sum``
    (range-partitioned, no per-area task); every row then donates its target to
    the ``n`` following ranks of its area, and one ``groupBy(area, rank)``
    averages the donors.  Shuffles are keyed by (area, rank), so a hot area is
    spread over all tasks.  Cost: ``n`` donor rows per incident.
    """
    name = f"DispatchArea_Last{n}_Avg"
    # The whole row is ranked, with a hash of it as last order, so ids may repeat.
    ranked = running_sum(df.withColumn("_tie", F.xxhash64(*df.columns)), [key], [time_col, id_col, "_tie"], F.lit(1), "_rank")
    donors = (ranked.select(key, "_rank", C.TARGET, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
                    .select(key, (F.col("_rank") + F.col("_k")).alias("_rank"), C.TARGET))
    lag = donors.groupBy(key, "_rank").agg(F.avg(C.TARGET).alias(name))
    return ranked.join(lag, [key, "_rank"], "left").select(*df.columns, name)


def add_concurrent_incidents(df: DataFrame, start: str = C.INCIDENT_DATETIME,
                             end: str = C.FIRST_ON_SCENE_DATETIME) -> DataFrame:
    """Incidents still open (started, not yet reached) when each call
    arrives: #{j != i : start_j <= start_i and end_j > start_i}.

    Starts and ends are first counted per timestamp (a timestamp shared by a
    third of the rows collapses to one row), the net +starts -ends is summed
    along time with ``running_sum``, and the result is joined back on the start
    time (AQE's skew join splits a hot start time).  An incident that ends no
    later than it starts is never open; one without an end stays open.
    """
    open_ever = F.coalesce(F.col(end) > F.col(start), F.lit(True))
    starts = df.groupBy(F.col(start).alias("_t")).agg(F.count_if(open_ever).alias("_s"))
    ends = df.where(open_ever & F.col(end).isNotNull()).groupBy(F.col(end).alias("_t")).agg(F.count(F.lit(1)).alias("_e"))
    net = (starts.join(ends, "_t", "full_outer")
                 .select("_t", (F.coalesce("_s", F.lit(0)) - F.coalesce("_e", F.lit(0))).alias("_net")))
    cum = running_sum(net, [], ["_t"], "_net", "_open").select(F.col("_t").alias(start), "_open")
    return (df.join(cum, start, "left")
              .withColumn("concurrent_incidents", (F.col("_open") - open_ever.cast("int")).cast("long")).drop("_open"))


# --- R1: conditions of the hour, the last known carried forward ---------------
def add_last_known(df: DataFrame, side: DataFrame, key: str, value: str, time_col: str = C.INCIDENT_DATETIME,
                   side_time: str = "hour") -> DataFrame:
    """``value`` of the latest row of ``side`` (``key``, ``side_time``, ``value``) at or before the hour of each row.

    Rows and side rows are united and ordered by key and time, a side row before the rows
    of its hour; each row takes the last known value.  Rows without key or time get null; of side rows of one hour the largest counts.
    Nothing is joined by range, and a key with most rows spans many tasks.
    """
    able = F.col(key).isNotNull() & F.col(time_col).isNotNull()
    names = df.columns
    rows = df.where(able).select(F.col(key).alias("_k"), F.date_trunc("hour", time_col).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_kind"),
                                 F.lit(None).cast(side.schema[value].dataType).alias("_v"), F.struct(*names).alias("_row"))
    kept = rows.schema["_row"].dataType
    marks = side.where(F.col(key).isNotNull() & F.col(side_time).isNotNull()).select(
        F.col(key).alias("_k"), F.col(side_time).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"),
        F.lit(None).cast(kept).alias("_row"))
    known = last_known(rows.unionByName(marks), ["_k"], ["_t", "_kind", "_v"], "_v", "_known").where("_kind = 1")
    rest = df.where(~able).withColumn(value, F.lit(None).cast(side.schema[value].dataType))
    return known.select("_row.*", F.col("_known").alias(value)).unionByName(rest)


# --- R2: nearest station --------------------------------------------------------
EARTH_KM = 6371.0088


def great_circle_km(lat1, lon1, lat2, lon2):
    """Great-circle distance of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def nearest_station(incidents: DataFrame, stations: DataFrame, key: str = C.KEY, cell: float | None = None) -> DataFrame:
    """R2: ``key``, ``station_id`` and ``distance_km`` of the nearest station of each incident (both with lat, lon).

    Stations lie in cells of ``cell`` degrees, by default of two stations or so.  A round looks, for
    each distinct cell of the incidents left, at the stations at most one cell away, less those that
    are nearest to no place of the cell; an incident is done when the best distance is no more than
    that to the border of those cells.  The next round's cells are twice as wide.  An incident meets its
    stations as one list, so its rows are not multiplied.  Equal distances (to a
    millimetre) go to the smaller station; incidents without coordinates get null; equal rows give one.
    For regions that don't reach a pole or the 180th meridian.
    """
    def in_cells(df, *names):
        return df.select(*names, "lat", "lon", F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))

    places = materialize(stations.where("station_id is not null and lat is not null and lon is not null").select("station_id", "lat", "lon"))
    of = places.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("a", F.min), ("z", F.max)))).first()
    out = None
    if of["n"]:
        height, width = of["z_lat"] - of["a_lat"], of["z_lon"] - of["a_lon"]
        cell = cell or max(math.sqrt(2 * height * width / of["n"]), (height + width) / of["n"], 1e-4)
        left = incidents.where("lat is not null and lon is not null").select(key, "lat", "lon").distinct()
    while of["n"]:
        y0, y1, x0, x1 = (math.floor(of[c] / cell) for c in ("a_lat", "z_lat", "a_lon", "z_lon"))
        here = in_cells(left, key)
        at = in_cells(places, "station_id").select(F.col("cy").alias("y"), F.col("cx").alias("x"),
                                                   F.struct("station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).alias("s"))
        # No place of a cell is farther from its middle than ``radius``, so the stations beyond the nearest and twice that are out.
        middle = (F.col("cy") + 0.5) * cell, (F.col("cx") + 0.5) * cell
        radius = F.greatest(*(great_circle_km(*middle, (F.col("cy") + k) * cell, F.col("cx") * cell) for k in (0, 1)))
        ring = F.sequence(F.lit(-1), F.lit(1))
        near = here.select("cy", "cx").distinct() \
            .select("*", F.explode(F.transform(ring, lambda v: F.col("cy") + v)).alias("y")).where(F.col("y").between(y0, y1)) \
            .select("*", F.explode(F.transform(ring, lambda v: F.col("cx") + v)).alias("x")).where(F.col("x").between(x0, x1)) \
            .join(at, ["y", "x"]).withColumn("far", great_circle_km(*middle, F.col("s.s_lat"), F.col("s.s_lon"))) \
            .groupBy("cy", "cx").agg(F.collect_list(F.struct("far", "s")).alias("all"), (F.min("far") + 1e-5).alias("least")) \
            .select("cy", "cx", F.transform(F.filter("all", lambda v: v["far"] <= F.col("least") + 2 * radius), lambda v: v["s"]).alias("near"))
        best = here.join(broadcast_if_small(materialize(near)), ["cy", "cx"], "left").withColumn("m", F.array_min(F.transform("near", lambda s: F.struct(
            F.round(great_circle_km(F.col("lat"), F.col("lon"), s["s_lat"], s["s_lon"]), 6).alias("d"), s["station_id"].alias("station_id"))))).drop("near")
        south, north = F.col("lat") - (F.col("cy") - 1) * cell, (F.col("cy") + 2) * cell - F.col("lat")
        west, east = F.col("lon") - (F.col("cx") - 1) * cell, (F.col("cx") + 2) * cell - F.col("lon")
        across = F.lit(EARTH_KM) * F.asin(F.cos(F.radians(F.greatest(F.abs(F.col("lat") - south), F.abs(F.col("lat") + north))))
                                          * F.sin(F.radians(F.least(west, east, F.lit(90.0)))))
        safe = F.least(F.lit(EARTH_KM) * F.radians(F.least(south, north)), across)
        whole = (F.col("cy") - 1 <= y0) & (F.col("cy") + 1 >= y1) & (F.col("cx") - 1 <= x0) & (F.col("cx") + 1 >= x1)
        best = best.withColumn("done", whole | F.coalesce(F.col("m.d") <= safe, F.lit(False)))
        done = best.where("done").select(key, "m.station_id", F.col("m.d").alias("distance_km"))
        out = done if out is None else out.unionByName(done)
        left = materialize(best.where("not done").select(key, "lat", "lon"))  # the others are found as they are read
        if left.isEmpty():
            break
        cell *= 2
    none = F.lit(None)
    lost = incidents.where("lat is null or lon is null") if out is not None else incidents
    lost = lost.select(key, none.cast(stations.schema["station_id"].dataType).alias("station_id"), none.cast("double").alias("distance_km"))
    return lost if out is None else out.unionByName(lost)
