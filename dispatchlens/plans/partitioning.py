"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def largest_leaf_bytes(df: DataFrame) -> int:
    """Optimizer size estimate (from file sizes) of the largest leaf relation.

    Reads plan statistics only; nothing is executed.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = []
    for i in range(leaves.size()):
        v = leaves.apply(i).stats().sizeInBytes()
        sizes.append(int(v) if isinstance(v, int) else int(str(v.toString())))
    return max(sizes) if sizes else 0


_UNITS = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def byte_size(value: str | int) -> int:
    """Parse a Spark byte-size setting such as ``4194304``, ``4m`` or ``4MB``."""
    text = str(value).strip().lower()
    digits = "".join(ch for ch in text if ch.isdigit())
    unit = text[len(digits):].strip() or "b"
    return int(digits) * _UNITS.get(unit, 1) if digits else 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work enough tasks.

    Spark never cuts a file into pieces smaller than ``openCostInBytes`` (4 MB),
    so when even the largest input relation is below that times the default
    parallelism, the scan yields fewer tasks than cores.  Only then is the
    frame spread round-robin over the default parallelism (an even shuffle
    with no key, so no skew).  Large inputs -- anything at cluster scale --
    are returned untouched.  The decision uses plan statistics only.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    open_cost = byte_size(spark.conf.get("spark.sql.files.openCostInBytes", "4194304"))
    if largest_leaf_bytes(df) >= open_cost * target:
        return df
    return df.repartition(target)
