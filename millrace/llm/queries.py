"""The registered queries of the training-data operators: opN_<name>(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embed_dedup, mixing, pii, quality, secrets, tokens, toxicity, warc
from .common import load
from .jaccard import jaccard_components


def tokenizer_path() -> str:
    """The vocabulary file of the registered queries; MILLRACE_TOKENIZER names another."""
    named = os.environ.get("MILLRACE_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.labelled_languages(docs, load(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(load(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(load(spark, sf_dir, "documents"), tokenizer_path())


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.build_archive(load(spark, sf_dir, "pages"))
    return warc.audit_report(archive, warc.with_faults(archive))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_personal_data": op3_personal_data,
    "op4_token_output": op4_token_output,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_warc_audit": op9_warc_audit,
    "op10_secrets": op10_secrets,
}

#: DuckDB SQL for those queries that SQL can express at whole-table size.
ORACLES: dict[str, str] = {}
