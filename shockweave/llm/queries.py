"""Registered queries of the operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockweave.llm import (
    bpe, decontaminate, jaccard_join, kd_sharding, line_dedup, mixing, near_vectors, periodic_runs, quality, secrets,
    token_output, vector_codes, warc,
)
from shockweave.llm.tables import importable, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_changed")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_output.read_digests(token_output.write_ids(table(spark, sf_dir, "documents"), path, end_id=1))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", F.expr("copies * size").alias("taken"), "row.source"
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.kd_shards(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return periodic_runs.run_digests(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_token_output, op3_line_dedup, op4_secrets, op5_mixing, op6_jaccard_join, op7_warc,
        op8_quality, op9_near_vectors, op10_kd_sharding, op11_bpe,
        op12_periodic_runs, op13_vector_codes,
    )
}
ORACLES = {"op3_line_dedup": line_dedup.ORACLE}
