"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import anntree, bpe, decontam, embdedup, langid, lm, merkle, periodic, quality, secret_scan, simhash, sql, tokenbin, toxicity
from lectern.llm.common import shared_folder, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.report(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    return tokenbin.report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anntree.report(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id, op2_simhash, op3_secrets, op4_lm, op5_bpe, op6_decontamination, op7_embeddings, op8_token_files, op9_toxicity, op10_quality, op11_nearest_neighbours,
    op12_merkle_manifest, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": sql.DECONTAMINATION, "op7_embeddings": sql.EMBEDDINGS, "op11_nearest_neighbours": sql.NEIGHBOURS, "op12_merkle_manifest": sql.MANIFEST,
        "op13_periodic_runs": sql.PERIODIC,
    }
