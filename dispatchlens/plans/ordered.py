"""Exact running sums along an order, per key, without a hot task.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task;
when one key holds a third of the data that task holds a third of the data.
``running_sum`` instead:

1. range-partitions on (key, order) -- sampled bounds split a hot key over
   many tasks -- and checkpoints that layout into ``spark.checkpoint.dir`` so
   both uses below see identical partitions (lineage cut, survives executor
   loss);
2. computes the running sum inside each (task, key) slice, a window whose
   largest group is one task's share of rows;
3. adds the sum of all earlier slices of the same key: a window over the
   small per-(task, key) totals table (at most tasks x keys rows), joined back
   with a size-checked broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_small, materialize


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column | str,
                out: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` along ``order``
    (``order`` must make rows unique within a key, e.g. end with an id)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    val = F.col(value) if isinstance(value, str) else value
    keys, order = list(keys), list(order)
    laid = materialize(
        df.withColumn("_v", val)
          .repartitionByRange(n, *keys, *order)
          .sortWithinPartitions(*keys, *order)
          .withColumn("_pid", F.spark_partition_id()))
    slice_w = (Window.partitionBy("_pid", *keys).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = laid.withColumn("_local", F.sum("_v").over(slice_w))
    totals = laid.groupBy("_pid", *keys).agg(F.sum("_v").alias("_tot"))
    before_w = (Window.partitionBy(*keys).orderBy("_pid") if keys else Window.orderBy("_pid")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("_pid", *keys, F.coalesce(F.sum("_tot").over(before_w), F.lit(0))
                                        .alias("_off")))
    joined = local.join(broadcast_if_small(offsets), ["_pid", *keys], "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))) \
                 .drop("_v", "_pid", "_local", "_off")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
               partitions: int | None = None) -> DataFrame:
    """The last non-null ``value`` per ``keys`` up to each row along ``order``, null before the first.

    Laid out as in ``running_sum``: a hot key spans many tasks; what a slice begins
    with is the last value of the earlier slices of its key, from a table of one row a slice and key.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, order = list(keys), list(order)
    laid = materialize(df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
                         .withColumn("_pid", F.spark_partition_id()))
    upto = (Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = laid.withColumn("_local", F.last(value, ignorenulls=True).over(upto))
    known = laid.where(F.col(value).isNotNull())
    ends = known.groupBy("_pid", *keys).agg(F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_m")) \
        .select("_pid", *keys, F.col("_m._value").alias("_end"))
    slices = laid.select("_pid", *keys).distinct().join(ends, ["_pid", *keys], "left")
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(slices.select("_pid", *keys, F.last("_end", ignorenulls=True).over(before).alias("_carried")))
    joined = local.join(broadcast_if_small(carried), ["_pid", *keys], "left")
    return joined.withColumn(out, F.coalesce("_local", "_carried")).drop("_pid", "_local", "_carried")


def _order_number(df: DataFrame, name: str) -> Column:
    """A monotone numeric image of a sortable column (for approximate quantiles)."""
    from pyspark.sql import types as T

    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        epoch = F.lit("1970-01-01 00:00:00").cast(dt)
        return F.timestamp_diff("MICROSECOND", epoch, F.col(name)).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


def _cut_row(df: DataFrame, n: int, total: int, order: Sequence[str]):
    """Order values of row ``n`` (1-based), the number of rows before its equals, and the number of its equals.

    Approximate quantiles of the first order column bracket the row, exact
    counts confirm the bracket (it widens until they do), and only the rows inside
    it are sorted, over range partitions; one row a partition comes to the driver.
    """
    key = F.coalesce(_order_number(df, order[0]), F.lit(-1.7e308))
    half = 3e-4
    while True:
        low, high = max(0.0, n / total - half), min(1.0, n / total + half)
        a, b = df.select(F.percentile_approx(key, F.array(F.lit(low), F.lit(high)), 10000)).first()[0]
        a, b = (a if low > 0 else float("-inf")), (b if high < 1 else float("inf"))
        before, upto = df.agg(F.count_if(key < F.lit(a)), F.count_if(key <= F.lit(b))).first()
        if before < n <= upto:
            break
        half *= 4
    near = materialize(df.where((key >= F.lit(a)) & (key <= F.lit(b))).select(*order).orderBy(*order)
                       .withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    at = before
    for part in near.groupBy("_pid").agg(F.count(F.lit(1)).alias("c"), F.min("_pos").alias("p")).orderBy("_pid").collect():
        if at + part["c"] >= n:
            cut = near.where((F.col("_pid") == part["_pid"]) & (F.col("_pos") == part["p"] + (n - at - 1))).first()
            break
        at += part["c"]
    # As text cast to the column's type: a Python datetime would pass through time zones.
    values = F.struct(*[F.lit(None if cut[c] is None else str(cut[c])).cast(df.schema[c].dataType).alias(c) for c in order])
    row = F.struct(*order)
    less, same = near.agg(F.count_if(row < values), F.count_if(row == values)).first()
    return values, before + less, same


def split_at(df: DataFrame, rows, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``rows(count)`` rows in ascending ``order``, and the others: exact, as filters on the input.

    Rows of equal order are told apart by a hash of all their columns; of
    identical rows, which are interchangeable, as many as needed come first.
    """
    names = df.columns
    hashed = df.withColumn("_tie", F.xxhash64(*names))
    order = [*order, "_tie"]
    total = hashed.count()
    n = rows(total)
    if n <= 0:
        return df.limit(0), df
    if n >= total:
        return df, df.limit(0)
    cut, less, same = _cut_row(hashed, n, total, order)
    row = F.struct(*order)
    if less + same == n:
        return hashed.where(row <= cut).select(*names), hashed.where(row > cut).select(*names)
    equal = hashed.where(row == cut)
    first = hashed.where(row < cut).unionByName(equal.limit(n - less))
    rest = hashed.where(row > cut).unionByName(equal.limit(less + same - n))
    return first.select(*names), rest.select(*names)


def first_n_by(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in ascending ``order``: exact, a filter that keeps the input's partitioning."""
    return split_at(df, lambda total: n, order)[0]
