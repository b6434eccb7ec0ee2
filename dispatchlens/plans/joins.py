"""Join helpers: broadcast only what has been measured.

A lookup derived from the data (group means, encodings) has no size bound known
up front.  ``materialize`` writes it once to the cluster's checkpoint folder
(reliable storage, lineage cut, survives executor loss) and ``lookup_join``
broadcasts it only when its measured size is under a limit; above the limit the
join stays a shuffle join, where AQE's skew-join handling splits hot keys of
the large side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Bytes (of text forms, so an upper bound for numbers) up to which a lookup is broadcast.
DEFAULT_BROADCAST_BYTES = 32 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint a (small) derived table into ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(table: DataFrame) -> int:
    """Size of a materialized table: the bytes of its values' text forms and 16 for each value."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0))
    return int(table.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0])


def broadcast_if_small(table: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a materialized table for broadcast if it measures at most ``max_bytes``.

    Beyond that the join stays a shuffle join, where Spark splits hot keys.
    """
    return F.broadcast(table) if measured_bytes(table) <= max_bytes else table


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Equi-join ``df`` with a lookup on ``keys``; the lookup is materialized and measured here."""
    return df.join(broadcast_if_small(materialize(lookup), max_bytes), list(keys), how)
