"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of ``documents``. Each works on all that its predecessor kept.

Cases: what the operators do with nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
holds here too: a document with a null text fails the quality rules, one with a null id is never taken for a copy, of
rows with the same id one stays, extra columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, decontaminate, ngram_join, pii, quality
from lorespark.llm.common import delete, enter_scope, leave_scopes, read, shared_dir, track


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of every group connected by similar pairs."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, token_ids, round_trip) of all documents."""
    kept = [c for c in ("doc_id", "source", "lang", "text") if c in docs.columns]
    return bpe.add_tokens(docs.select(*kept), keep_text=False)


def _stage(name: str, f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # the output of the stages before has been written by now, so the tables that they cut can go
        leave_scopes(spark, "pipeline-")
        enter_scope(spark, f"pipeline-{name}")
        try:
            return f(spark, docs, sf_dir)
        finally:
            enter_scope(spark, "")

    return run_stage


STAGES = [(f.__name__, _stage(f.__name__, f)) for f in (quality_rules, near_duplicates, decontamination, redaction, tokens)]

#: BPE has no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again, but for the last.

    A stage's table goes when the next one is written; the last of them, which the result reads, when the process ends.
    """
    docs, base, before = read(spark, sf_dir, "documents"), track(spark, f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{base}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
