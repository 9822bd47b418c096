"""Analytics packs: entities of a domain, synonyms by constructed names, fingerprints shared by domains; quality of file trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHAPE = "domain string, path string, kind string, entity string, ord int, key string, value string, raw string"


def canonical(s: str) -> str:
    return str(s).upper().replace("_", "-").replace(" ", "-").replace(".", "-")


def pack_facts(text: str, domain: str, path: str) -> list[tuple]:
    """Facts of one pack: the domain with its fingerprints, enums, tables, questions and guardrails; metrics; dimensions; synonyms."""
    import json

    import yaml

    try:
        data = yaml.safe_load(text or "")
    except yaml.YAMLError:
        return []
    if not isinstance(data, dict):
        return []
    domain = domain or str(data.get("domain") or "unknown")
    out: list[tuple] = []
    add = lambda kind, entity, key, value, raw=None: out.append((domain, path, kind, entity, len(out), key, value, None if raw is None else json.dumps(raw, sort_keys=True, default=str)))
    items = lambda x: [i for i in x or [] if isinstance(i, dict)] if isinstance(x, list) else [{"id": k, **v} if isinstance(v, dict) else {"id": k, "value": v} for k, v in (x or {}).items()]
    flat = lambda v: "+".join(map(str, v)) if isinstance(v, list) else str(v)
    own = f"DOMAIN-{canonical(domain)}"
    add("entity", own, "description", str(data.get("description") or ""))
    for kind, mark in (("fingerprints", "FP"), ("enums", "ENUM"), ("tables", "TABLE"), ("kbqs", "KBQ")):
        for x in items(data.get(kind)):
            name = x.get("id") or x.get("name") or x.get("column") or ""
            add("field", own, f"{mark}-{canonical(name)}", flat(next((x[k] for k in ("patterns", "values", "columns", "template", "question", "value", "description") if x.get(k)), "")), {k: x[k] for k in ("id", "patterns", "data_types", "description") if k in x})
    guards = data.get("guardrails") or {}
    for k in ("pii", "compliance"):
        if isinstance(guards, dict) and guards.get(k):
            add("field", own, k.upper(), flat(guards[k]), guards[k])
    words = (data.get("vocabulary") or {}).get("entities") or {}
    for generic, names in words.items() if isinstance(words, dict) else ():
        for n in names if isinstance(names, list) else [names]:
            add("alias", own, str(generic), str(n))
    ontology = data.get("ontology") or {}
    for kind, mark in (("metrics", "METRIC"), ("dimensions", "DIM")):
        for x in items(ontology.get(kind)):
            name = f"{mark}-{canonical(domain)}-{canonical(str(x.get('id') or x.get('name') or '').split('.')[-1])}"
            add("entity", name, "description", str(x.get("definition") or x.get("description") or ""))
            for k in ("formula", "grain", "unit", "hierarchy", "columns"):
                if x.get(k):
                    add("field", name, k.upper(), flat(x[k]), x[k])
    for x in items(ontology.get("synonyms")):
        if x.get("term") and x.get("canonical"):
            add("synonym", None, str(x["term"]), str(x["canonical"]))
    return out


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of all ``<folder>/<domain>/v1/pack.yaml``."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/v1/pack.yaml").select(F.col("path"), F.col("content").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SHAPE.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.text) for r in pack_facts(t, p.split("/")[-3], p)], columns=cols)

    return files.mapInPandas(run, SHAPE)


def synonym_aliases(synonyms: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, term): synonyms (term, canonical) whose ``domain.metrics.name`` or ``domain.dimensions.name`` names an entity."""
    part = F.split("canonical", "\\.")
    canon = lambda c: F.translate(F.upper(c), "_ .", "---")
    mark = F.when(part[1] == "metrics", "METRIC").when(part[1] == "dimensions", "DIM")
    s = synonyms.filter((F.size(part) >= 3) & mark.isNotNull() & (F.coalesce("term", F.lit("")) != ""))
    s = s.select("term", F.concat_ws("-", mark, canon(part[0]), canon(F.array_join(F.slice(part, 3, 1 << 20), "."))).alias("entity"))
    return s.join(entities.select("entity").distinct(), "entity").select("entity", "term").distinct()


def shared_fingerprints(fields: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each (key, signature): the first holder, and the others in order. Fields have (holder, key, signature, ord)."""
    g = fields.groupBy("key", "signature").agg(F.array_sort(F.collect_list(F.struct(order, "holder"))).alias("s"))
    names = F.transform("s", lambda x: x["holder"])
    return g.select("key", "signature", names[0].alias("holder"), F.array_join(F.slice(names, 2, 1 << 20), ",").alias("others"))


def fingerprint_dedup(facts: DataFrame) -> DataFrame:
    """Facts of packs without the fingerprints that an earlier domain has alike; the first keeps the paths of the rest."""
    fp = facts.filter("key LIKE 'FP-%'")
    first = shared_fingerprints(fp.select(F.col("path").alias("holder"), "key", F.coalesce("raw", F.lit("")).alias("signature"), F.struct("path", "ord").alias("ord")))
    kept = fp.withColumn("signature", F.coalesce("raw", F.lit(""))).join(first.withColumnRenamed("holder", "path"), ["key", "signature", "path"]).dropDuplicates(["key", "signature", "path"]).drop("signature")
    return facts.filter("key NOT LIKE 'FP-%' OR key IS NULL").withColumn("others", F.lit("")).unionByName(kept.select(*facts.columns, "others"))


def file_quality(files: DataFrame, most_lines: int = 500) -> DataFrame:
    """(path, check, n) over (path, text): long files, public functions without a return type, Python sources without a test of their name."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    t = files.select("path", "text", name.alias("name"), F.size(F.split("text", "\n")).alias("lines"))
    py = t.filter(F.col("path").endswith(".py"))
    bare = F.size(F.regexp_extract_all("text", F.lit("(?m)^(?:async )?def (?!_|test_)\\w+\\((?:[^()]|\\([^()]*\\))*\\)\\s*:"), 0))
    tested = py.select("name").distinct()
    source = py.filter(~F.col("name").rlike("^(test_|conftest)") & (F.col("name") != "__init__.py") & ~F.col("path").rlike("alembic|migration")).withColumn("test", F.concat(F.lit("test_"), "name"))
    return (
        t.filter(F.col("lines") > most_lines).select("path", F.lit("long_file").alias("check"), F.col("lines").alias("n"))
        .unionByName(py.select("path", F.lit("no_return_type").alias("check"), bare.alias("n")).filter("n > 0"))
        .unionByName(source.join(tested.select(F.col("name").alias("test")), "test", "left_anti").select("path", F.lit("no_test").alias("check"), F.lit(1).alias("n")))
    )


def commit_conventions(commits: DataFrame, last: int = 30, top: int = 8) -> tuple[DataFrame, DataFrame]:
    """((commits, typed, conventional), (prefix, n)): of the latest commit lines (ord, line), whether over half read ``type(scope): text``, and the commonest types."""
    latest = commits.orderBy(F.col("ord").desc()).limit(last)  # a report on the last commits
    kind = F.regexp_extract("line", "^(?:[0-9a-f]{7,40} )?([a-z]+)(?:\\([^)]*\\))?!?: \\S", 1)
    t = latest.withColumn("prefix", F.nullif(kind, F.lit("")))
    verdict = t.agg(F.count("*").alias("commits"), F.count("prefix").alias("typed")).withColumn("conventional", F.col("typed") > F.col("commits") / 2)
    return verdict, t.filter("prefix IS NOT NULL").groupBy("prefix").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "prefix").limit(top)


def test_setup(files: DataFrame) -> DataFrame:
    """(path, framework, threshold) of test configurations among (path, text)."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = (
        F.when((name == "pytest.ini") | ((name == "pyproject.toml") & F.col("text").contains("pytest")), "pytest").when(name.rlike("^vitest\\.config\\.m?[jt]s$"), "vitest")
        .when(name.rlike("^jest\\.config\\.m?[jt]s$"), "jest").when(name == "playwright.config.ts", "playwright")
    )
    return files.select("path", kind.alias("framework"), F.regexp_extract("text", "cov-fail-under[=\\s]+([0-9]+)", 1).try_cast("int").alias("threshold")).filter("framework IS NOT NULL")


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")
