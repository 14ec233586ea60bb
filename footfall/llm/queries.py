"""The named queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from footfall.llm import (
    hyperminhash, lengths, licenses, lm_score, main_text, manifest, mixing, neighbours, packing, quality,
    sql, topk, warc, whitening,
)
from footfall.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_lengths(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", rows["deviation"].cast("long"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proofs(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_quality": op3_quality,
    "op4_threshold_topk": op4_threshold_topk,
    "op5_source_mix": op5_source_mix,
    "op6_length_histogram": op6_length_histogram,
    "op7_main_text": op7_main_text,
    "op8_context_mixing": op8_context_mixing,
    "op9_nn_descent": op9_nn_descent,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op2_hyperminhash": sql.NEAR_DUPLICATES,
    "op4_threshold_topk": sql.TOP_PRODUCTS,
    "op5_source_mix": sql.SOURCE_MIX,
    "op9_nn_descent": sql.NEAR_VECTORS,
    "op10_warc": sql.WARC,
    "op12_merkle_manifest": sql.MANIFEST,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
