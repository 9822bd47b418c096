"""Inputs of the registered queries: the shared tables, and normalised views of them in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.functions.cuts import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # texts: work on them outweighs moving them


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the shared tables, planned by Catalyst."""
    import re

    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)
