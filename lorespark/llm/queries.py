"""Queries of this subpackage and their DuckDB SQL, by the names under which ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import bpe, decontaminate, ngram_join, pii, quality, reshard, secrets, suffix_dedup, tokenids, warc
from lorespark.llm.common import read


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_pages(read(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard(read(spark, sf_dir, "documents"), shards=24)[0]


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode(read(spark, sf_dir, "documents"))[0]


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(read(spark, sf_dir, "documents"))


QUERIES = {
    "op2_pii_spans": op2_pii_spans,
    "op3_decontaminate": op3_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op1_token_ids": op1_token_ids,
    "op7_bpe": op7_bpe,
    "op4_flow_reshard": op4_flow_reshard,
    "op5_secret_scan": op5_secret_scan,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL = {
    "op8_suffix_dedup": suffix_dedup.oracle(),
    "op6_ngram_jaccard": ngram_join.oracle(),
    "op5_secret_scan": secrets.oracle(),
    "op9_warc_fixity": warc.oracle(),
    "op10_quality_rules": quality.oracle(),
}
