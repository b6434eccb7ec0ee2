"""Reading the text tables, and shared folders for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, for sessions whose workers don't find it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        package = Path(__file__).resolve().parents[1].name
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package}", "zip", root, package)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


_shipped: set[str] = set()
#: Bytes of an Arrow batch between Spark and its Python workers, where the session names none.
BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` instead of Spark's 64 MB: a batch stands in the executor's direct memory and in the worker."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; every query begins here, so the package is shipped here too."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Cuts the lineage, so that later stages neither repeat the work nor depend on
    an executor that may be lost.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_row(df: DataFrame, column: str, keep: list[str], schema: str, work: Callable[[pa.RecordBatch], list],
            most: int | None = None) -> DataFrame:
    """``keep`` columns of every row with the arrays that ``work`` makes of the row's text.

    ``work`` gets runs of rows of bounded text size and returns one array for
    each field of ``schema``.  Other columns of ``df`` never leave the JVM, so
    their names can't clash with the new ones.
    """
    from .text import SLICE_BYTES, slices

    fields = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(schema).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most or SLICE_BYTES):
            made = work(part)
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names=fields.names)

    return df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, fields)


#: Bits of a bitmap, as a power of two.
FILTER = 26


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for the first ``FILTER`` bits of each of ``keys`` (one long column); of fixed size."""
    key = F.col(keys.columns[0])
    place, bit = F.shiftrightunsigned(key, 64 - FILTER + 6), F.shiftrightunsigned(key, 64 - FILTER).bitwiseAND(F.lit(63)).cast("int")
    found = keys.select(place.alias("place"), bit.alias("bit")).groupBy("place") \
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    word = bits[(key >> np.uint64(64 - FILTER + 6)).astype(np.int64)]
    return (word >> ((key >> np.uint64(64 - FILTER)) & np.uint64(63))) & np.uint64(1) == 1
