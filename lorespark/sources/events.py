"""Event logs as JSON lines, agent traces, question sets: batch and streaming readers and an append-only writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HYDRATION = "timestamp string, session_id string, question_hash string, sections_requested array<string>, sections_matched int, tokens_injected int, rehydration_triggered boolean, latency_ms double"
CODE = "v int, ts timestamp, session_id string, event_type string, latency_ms double, pack_version string, success boolean, root_hash string, module_hash string, context_hash string, name_hash string, query_hash string, path_hash string, entities int, files int, k int, n_returned int, depth int, prior_hydrate_count int, elapsed_calls int, cluster_size int, alpha double, error_code string"
TRACE = "entities array<map<string,string>>, tool string, result map<string,string>, decision string"


def read(spark: SparkSession, path: str, schema: str = HYDRATION) -> DataFrame:
    """Events of a folder; blank and malformed lines are skipped, and a missing folder gives none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream(spark: SparkSession, path: str, schema: str = HYDRATION, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def logged(questions: DataFrame, text: str = "question") -> DataFrame:
    """Events without their text: only its SHA-256 is kept."""
    return questions.withColumn("question_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).drop(text)


def trace_steps(steps: DataFrame, by: str = "session_id") -> DataFrame:
    """Facts of agent steps (session, step, entities, tool, result, decision): entities, tool results and decisions, later steps a little more salient."""
    kind = F.when(F.size(F.coalesce("entities", F.array())) > 0, "entities").when(F.col("tool").isNotNull(), "tool").when(F.col("decision").isNotNull(), "decision").otherwise("step")
    s = steps.withColumn("kind", kind).withColumn("salience", F.lit(1.0) + 0.01 * F.col("step"))
    name = F.when(F.col("kind") == "tool", F.upper(F.regexp_replace("tool", "[\\s_]+", "-"))).when(F.col("kind") == "decision", F.concat(F.lit("DECISION-"), F.col("step").cast("string"))).otherwise(F.concat(F.lit("STEP-"), F.col("step").cast("string")))
    each = s.withColumn("e", F.explode_outer(F.when(F.col("kind") == "entities", F.col("entities"))))
    entity = F.when(F.col("kind") == "entities", F.upper(F.regexp_replace(F.coalesce(F.element_at("e", "name"), F.lit("UNKNOWN")), "[\\s_]+", "-"))).otherwise(name)
    pairs = F.when(F.col("kind") == "entities", F.map_filter("e", lambda k, v: k != "name")).when(F.col("kind") == "tool", F.coalesce("result", F.create_map().cast("map<string,string>"))).when(F.col("kind") == "decision", F.create_map(F.lit("decision"), F.col("decision"))).otherwise(F.create_map().cast("map<string,string>"))
    return each.select(by, "step", "kind", entity.alias("entity"), "salience", F.explode_outer(pairs).alias("key", "value"))
