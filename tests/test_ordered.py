"""Skew-proof running sums agree with a plain window, including a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from dispatchlens.plans.ordered import running_sum


def test_running_sum_matches_window_with_hot_key(spark):
    n = 30000
    df = spark.range(n).select(
        F.col("id"),
        # key 0 holds a third of all rows
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("k"),
        ((F.col("id") * 7919) % 1000).alias("t"),
        (F.col("id") % 13).alias("v"))
    got = running_sum(df, ["k"], ["t", "id"], "v", "rs", partitions=8)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs", F.sum("v").over(w))
    diff = got.select("id", "rs").exceptAll(want.select("id", "rs")).count()
    assert diff == 0 and got.count() == n


def test_global_running_sum(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1).alias("v"))
    got = running_sum(df, [], ["id"], "v", "rs", partitions=4)
    assert got.where(F.col("rs") != F.col("id") + 1).count() == 0


def test_first_n_by_exact_and_distributed(spark):
    from dispatchlens.plans.ordered import first_n_by

    df = spark.range(20000).select(
        F.col("id"), F.timestamp_add("SECOND", ((F.col("id") * 7919) % 5000).cast("int"),
                                     F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("t")).repartition(6)
    want = [r["id"] for r in df.orderBy("t", "id").limit(300).collect()]
    got = first_n_by(df, 300, ["t", "id"])
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert got.rdd.getNumPartitions() == 6
