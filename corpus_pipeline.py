"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next stage's ``docs``, so a
lost executor costs one stage at most.  All stages but the last return the columns
of ``documents``; the last adds ``pieces`` and ``decoded``.  Texts pass between
Spark and its Python workers in batches of 8 MB, where the session names no size.

Defined results: null and empty texts fail the quality rules; equal rows leave one;
an empty table passes through all stages; extra columns are kept, but the last
stage replaces columns named as its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlens.llm import bag_minhash, decontaminate, piece_sampling, quality_bands, suffix_columns
from dispatchlens.llm.tables import bounded_batches, stored, table

#: Characters whose lattices a task of the last stage keeps: encoding and decoding run in one stage, so four workers stand
#: in an executor of two cores.
KEPT = 1 << 19


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules."""
    bounded_batches(spark)
    return quality_bands.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    bounded_batches(spark)
    return bag_minhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that occur again out of the texts."""
    bounded_batches(spark)
    cut = suffix_columns.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    bounded_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add sampled pieces of each text, and the text that they decode to."""
    bounded_batches(spark)
    own = [c for c in docs.columns if c not in ("pieces", "decoded")]
    return piece_sampling.decode(piece_sampling.encode(docs, tuple(own), kept=KEPT), (*own, "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Hash-seeded draws, components and compression ratios have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
