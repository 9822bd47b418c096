"""Saved state, question sets, result files, overlays, generated corpora and the schedule of retries."""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_state(df: DataFrame, path: str) -> str:
    """Writes a new version and then, by one rename, names it the current one: readers see the old state or the new."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{version}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, current = hadoop.Path(f"{path}/new-{version}"), hadoop.Path(f"{path}/CURRENT")
    fs = current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(new)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, current, options)
    return version


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version; an empty table where nothing has been saved."""
    jvm = spark.sparkContext._jvm
    current = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not current.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(current):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v-{spark.read.text(f'{path}/CURRENT').first()[0]}")


QUESTIONS = "id string, question string, expected string, difficulty string, entities array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets in YAML: a list, or a mapping with one under ``questions``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for b in batches:
            rows = []
            for text in b["text"]:
                data = yaml.safe_load(text or "") or []
                for q in data.get("questions") or [] if isinstance(data, dict) else data:
                    rows.append((str(q.get("id", "")), str(q.get("question", "")), str(q.get("expected", "")), str(q.get("difficulty", "")), [str(e) for e in q.get("entities") or []]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in QUESTIONS.split(", ")])

    return spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text")).mapInPandas(run, QUESTIONS)


def save_results(df: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    df.write.mode("overwrite").json(path)


def overlay(base: DataFrame, extra: DataFrame, below: str, config: str) -> DataFrame:
    """Files (path, text) of two corpora: the second below a folder of the first, without its configuration."""
    e = extra.filter(~F.col("path").rlike(f"(^|/){config}$")).withColumn("path", F.concat(F.lit(f"{below.rstrip('/')}/"), "path"))
    return base.join(e.select("path"), "path", "left_anti").unionByName(e.select(*base.columns))


def retry_schedule(spark: SparkSession, attempts: int, first: float = 1.0, most: float = 60.0) -> DataFrame:
    """(attempt, wait, waited) of an exponential back-off, in seconds."""
    wait = F.least(F.lit(first) * F.pow(F.lit(2.0), F.col("id")), F.lit(most))
    rows = spark.range(attempts).select(F.col("id"), wait.alias("wait"), F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: F.least(F.lit(first) * F.pow(F.lit(2.0), i), F.lit(most))).alias("all"))
    return rows.select((F.col("id") + 1).alias("attempt"), "wait", F.aggregate("all", F.lit(0.0), lambda a, x: a + x).alias("waited"))


def observed(events: DataFrame, verdicts: DataFrame, session: str = "session_id") -> DataFrame:
    """(name, confirmed, ts) for every section that an answered question used: confirmed where the guard found nothing."""
    e = events.select(session, "ts", F.explode("sections").alias("name"))
    return e.join(verdicts.select(session, (F.col("advice") == "ok").alias("confirmed")), session).select("name", "confirmed", "ts")


def generated(words: int, seed: int) -> Iterator[tuple[str, str]]:
    """(path, text) of a corpus of about ``words`` words: 65 % entities, then rules and notes. Seeded."""
    r, made, k = random.Random(seed), 0, 0
    noun = ("customer", "order", "invoice", "payment", "shipment", "product", "supplier", "contract", "ticket", "refund", "account", "ledger")
    say = lambda n: " ".join(r.choice(("the", "record", "must", "match", "before", "after", "review", "status", "of", "each", "daily", "check", "source", "value", *noun)) for _ in range(n))
    while made < words:
        name, share = f"{r.choice(noun)}_{k}", r.random()
        if share < 0.65:
            fields = "".join(f"{f}: {say(r.randint(3, 12))}\n" for f in r.sample(("owner", "usage", "quality", "lineage", "access", "schedule", "format", "null_policy"), 6))
            text = f"entity: {name}\ndescription: {say(12)}\ngolden_source: {r.choice(('CRM', 'ERP', 'billing'))}\nidentifier:\n  name: {name}_id\n  type: UUID\n  required: true\npii: [name, email]\nretention:\n  months: {r.choice((12, 36, 84))}\nbelongs_to:\n  entity: {r.choice(noun)}_{max(0, k - r.randint(1, 9))}\n  field: parent_id\n{fields}"
            path = f"entities/{name}.yaml"
        elif share < 0.8:
            path, text = f"rules/{name}.yaml", "rules:\n" + "".join(f"  rule_{k}_{i}: {say(r.randint(6, 20))}\n" for i in range(8))
        else:
            path, text = f"docs/{name}.md", f"# Entity: {name.upper()}\n\n## Known issues\n\n" + "".join(f"- {say(r.randint(8, 25))}.\n" for _ in range(8)) + f"\n> **Warning:** {say(9)}\n"
        made, k = made + len(text.split()), k + 1
        yield path, text
