"""Scans of a mixed-format corpus folder: discovery, configuration, extraction by format."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.sources import extract, markdown, yaml_subset

CONFIG_NAMES = ("corpus.yaml", "corpus.yml")
FORMATS = "CASE lower(regexp_extract(rel_path, '\\\\.([A-Za-z]+)$', 1)) WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'md' THEN 'md' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' WHEN 'csv' THEN 'csv' END"


def load_config(text: str) -> dict:
    """domain, scope, author, include, exclude, entity_aliases, golden_sources, template; names in capitals."""
    raw = yaml_subset.parse(text) or {}
    upper = lambda m: {str(k).upper(): v for k, v in (m or {}).items()}
    return {"domain": raw.get("domain") or "", "scope": raw.get("scope") or "", "author": raw.get("author") or "", "include": raw.get("include") or [], "exclude": raw.get("exclude") or [], "entity_aliases": upper(raw.get("entity_aliases")), "golden_sources": upper(raw.get("golden_sources")), "template": raw.get("template")}


def matches_any(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(path.replace("\\", "/"), p) for p in patterns)


def discover(spark: SparkSession, folder: str, include: list[str] = (), exclude: list[str] = (), config: tuple[str, ...] = CONFIG_NAMES) -> DataFrame:
    """(rel_path, fmt, src_ord, content): excludes go first, then includes (none: all); ordered by relative path.

    The content column is only read where a later step selects it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    f = files.withColumn("rel_path", F.expr(f"substring(path, instr(path, '{root}/') + {len(root) + 1})")).withColumn("fmt", F.expr(FORMATS))
    f = f.filter(F.col("fmt").isNotNull() & ~F.col("rel_path").isin(*config))
    for p in exclude:
        f = f.filter(~F.col("rel_path").rlike(T.glob_regex(p)))
    if include:
        cond = F.lit(False)
        for p in include:
            cond = cond | F.col("rel_path").rlike(T.glob_regex(p))
        f = f.filter(cond)
    return f.select("rel_path", "fmt", "modificationTime", "length", "content")


def texts(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "fmt", F.decode("content", "UTF-8").alias("text"))


def facts(files: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of all formats in one shape: structured files are parsed whole in Python, Markdown stays in the JVM."""
    t = texts(files)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["path", "fmt", "kind", "entity", "ord", "key", "value", "raw", "certainty", "line"]
        for b in batches:
            rows = []
            for path, fmt, text in zip(b.rel_path, b.fmt, b.text):
                stem = posixpath.splitext(posixpath.basename(path))[0]
                rows += [(path, fmt, kind, e, i, k, v, raw, how, line) for i, (kind, e, k, v, raw, how, line) in enumerate(extract.extract(fmt, text or "", stem))]
            yield pd.DataFrame(rows, columns=cols).astype({"line": "Int32"})

    structured = t.filter("fmt <> 'md'").mapInPandas(parse, extract.SHAPE)
    return structured.unionByName(markdown.facts(t.filter("fmt = 'md'").select(F.col("rel_path").alias("path"), "text"), aliases))
