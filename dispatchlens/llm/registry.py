"""Queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, chat, decontaminate, license_scan, periodic_runs, phrase_tries, piece_sampling, quality_bands, shingle_trees, subword_quality, suffix_columns, tag_paths, toxic_crf
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scanned(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extracted(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_crf.digest(toxic_crf.tagged(docs, toxic_crf.fit(docs, table(spark, sf_dir, "labels"))))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword_quality.digest(subword_quality.scored(docs, subword_quality.fit(docs, table(spark, sf_dir, "labels"))))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.report(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = piece_sampling.decode(piece_sampling.encode(docs))
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
                        F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(table(spark, sf_dir, "documents"),
                                                      table(spark, sf_dir, "benchmark"))).drop("longest_match")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_columns.digest(docs, suffix_columns.repeats(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.judged(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_trees.linked(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, those with a seed that ends in 0 after a part of them was made to repeat."""
    seed = F.crc32(F.col("doc_id").cast("string"))
    return periodic_runs.digest(periodic_runs.annotated(table(spark, sf_dir, "documents"), plant=seed))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_tries.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_license_scans": op2_license_scans,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_join": op11_ngram_join,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLE: dict[str, str] = {
    "op1_chat_formatting": chat.SQL,
    "op8_benchmark_decontamination": decontaminate.sql(),
    "op13_phrase_collocations": phrase_tries.SQL,
}
