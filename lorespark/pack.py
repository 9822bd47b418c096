"""Entry points: pack a corpus folder, look sections up by name or by question, list them; errors as envelopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.cuts import cut
from lorespark.operators import compress
from lorespark.operators import resolve as R
from lorespark.operators import retrieval
from lorespark.sources import corpus, documents

CODES = ("budget_exceeded", "ignored_path", "internal_parse_error", "invalid_input", "pack_not_loaded", "path_outside_root", "unknown_module", "unknown_symbol")


def envelope(code: str, message: str, hint: str = "") -> dict:
    """The shape in which callers outside Python get errors."""
    if code not in CODES:
        raise ValueError(f"unknown code {code}")
    return {"error": {"code": code, "message": message, "hint": hint}}


@dataclass
class Pack:
    """Tables of a packed corpus: facts and nodes are written once, to the folder that executors share; the rest is lazy."""

    facts: DataFrame
    source_words: int
    domain: str
    relationships: DataFrame
    conflicts: DataFrame
    nodes: DataFrame

    def text(self, **how) -> DataFrame:
        return documents.serialise(self.nodes, **how)

    def compressed(self, preset: str = "", **how) -> DataFrame:
        """Nodes under a preset, or under ``max_ratio``, ``floor`` and ``keep``: see :func:`lorespark.operators.compress.compress`."""
        return compress.compress(self.facts, self.domain, self.source_words, preset, **how)

    def overview(self) -> DataFrame:
        return documents.overview(self.nodes)

    def json(self) -> DataFrame:
        return documents.to_json(self.nodes)

    def manifest(self) -> DataFrame:
        return documents.manifest(self.nodes)

    def sections(self) -> DataFrame:
        """(section, words): what there is to ask for."""
        return self.nodes.filter("section <> ''").groupBy("section").agg(F.sum(F.coalesce(T.word_count(F.col("value")), F.lit(0))).alias("words"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(check, entity_a, entity_b, detail) of the checks over extracted fields: retention, field types, null policy."""
    f = facts.filter("kind = 'field'").select("entity", "ord", "key", "value", "path").withColumn("o", F.struct("path", "ord", "entity"))
    months = f.filter("key = 'RETENTION'").withColumn("m", T.months(F.col("value"))).filter("m IS NOT NULL").withColumn("g", F.lit(1))
    held = R.pair_conflicts(months.filter("entity IS NOT NULL"), ["g"], "m", "o").select(F.lit("retention").alias("check"), "entity_a", "entity_b", F.concat_ws(" / ", F.col("value_a").cast("string"), F.col("value_b").cast("string")).alias("detail"))
    typed = f.filter("key <> 'IDENTIFIER'").withColumn("t", F.regexp_extract("value", "\\(([A-Z][A-Z0-9_(), ]*?)(?:,|\\))", 1)).filter("t <> ''")
    types = R.pair_conflicts(typed, ["key"], "t", "o").filter("entity_a <> entity_b").select(F.lit("type").alias("check"), "entity_a", "entity_b", F.concat_ws(" ", "key", F.concat_ws(" / ", "value_a", "value_b")).alias("detail"))
    ident = f.filter("key = 'IDENTIFIER'").select("entity", F.regexp_extract("value", "^([A-Za-z0-9_]+)", 1).alias("field"), F.col("value").contains("required").alias("required"))
    policy = f.filter("key = 'NULL-POLICY'").select("entity", F.explode(F.regexp_extract_all("value", F.lit("([A-Za-z0-9_]+)\\(nullable\\)"), 1)).alias("field")).withColumn("nullable", F.lit(True))
    nulls = R.null_policy_conflicts(ident, policy).select(F.lit("null policy").alias("check"), F.col("entity").alias("entity_a"), F.col("entity").alias("entity_b"), F.col("field").alias("detail"))
    return held.unionByName(types).unionByName(nulls)


def pack(spark: SparkSession, folder: str, config: dict | None = None) -> Pack:
    """Discovery, extraction, alias resolution, inverse relationships, conflict checks and the document of a folder."""
    c = config or {}
    files = corpus.discover(spark, folder, c.get("include", []), c.get("exclude", []))
    facts = cut(corpus.facts(files, c.get("entity_aliases")), "extracted")
    own = facts.filter("kind = 'alias'").select(F.col("value").alias("alias"), F.col("entity").alias("target"))
    given = [(a, n) for n, all_ in (c.get("entity_aliases") or {}).items() for a in all_]
    if given:
        own = own.unionByName(spark.createDataFrame(given, "alias string, target string"))
    named = R.resolve_aliases(facts.filter("entity IS NOT NULL"), own, "entity")
    facts = cut(named.withColumn("entity", F.col("canonical")).select(*facts.columns).unionByName(facts.filter("entity IS NULL")), "facts")
    rels = facts.filter("kind = 'relationship'").select(F.col("entity").alias("source"), F.col("value").alias("target"), F.col("key").alias("rel_type"), F.coalesce(F.get_json_object("raw", "$.cascade"), F.lit("")).isin("true", "True", "yes").alias("cascade"))
    rels = cut(R.resolve_aliases(rels, own, "target").drop("target").withColumnRenamed("canonical", "target"), "relationships")
    names = facts.filter("kind = 'entity'").select(F.col("entity").alias("name")).distinct()
    inferred = R.inverse_relationships(rels, names)
    all_rels = rels.withColumn("certainty", F.lit("explicit")).unionByName(inferred.select("source", "target", "rel_type", "cascade", "certainty"))
    extra = inferred.select(F.lit("").alias("path"), F.lit("").alias("fmt"), F.lit("field").alias("kind"), F.col("source").alias("entity"), F.lit(1 << 20).alias("ord"), F.upper("rel_type").alias("key"), F.concat(F.lit("@ENTITY-"), "target", F.lit("("), "cardinality", F.lit(")")).alias("value"), F.lit(None).cast("string").alias("raw"), F.lit("inferred").alias("certainty"), F.lit(None).cast("int").alias("line"))
    whole = cut(facts.unionByName(extra), "facts")
    if c.get("strict"):
        whole = whole.filter("certainty <> 'inferred'")
    domain = c.get("domain") or "corpus"
    words = corpus.texts(files).agg(F.coalesce(F.sum(T.word_count(F.col("text"))), F.lit(0)).alias("n")).first()["n"]
    return Pack(whole, words, domain, all_rels, conflicts(facts), cut(documents.from_facts(whole, domain, domain), "nodes"))


def by_name(nodes: DataFrame, names: list[str], layers: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """(ord, section, text) of the named sections, in the order asked and with repeats; names match in any case, the last of equals wins."""
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    s = _section_texts(nodes)
    layer = F.lower(F.coalesce(F.regexp_extract("source", "layer=([A-Za-z]+)", 1), F.lit("")))
    s = s.withColumn("layer", F.when(layer == "", "rules").otherwise(layer)).withColumn("confidence", F.coalesce(F.expr("try_cast(nullif(regexp_extract(source, 'confidence=([0-9.]+)', 1), '') AS DOUBLE)"), F.lit(1.0)))
    if layers:
        s = s.filter(F.col("layer").isin([x.lower() for x in layers]))
    if min_confidence > 0:
        s = s.filter(F.col("confidence") >= min_confidence)
    return retrieval.lookup(asked, s.withColumnRenamed("section", "name")).select("ord", "name", "text", "layer", "confidence")


def by_question(nodes: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(qid, section, score, rank) for (qid, text) rows: the sections with the largest share of a question's words."""
    s = _section_texts(nodes).select("section", F.concat_ws(" ", "section", "text").alias("text"), "sec_ord")
    hits = retrieval.overlap(questions, s, "qid", "section").join(s.select("section", "sec_ord"), "section")
    return retrieval.top_k(hits, ["qid"], [F.col("score").desc(), F.col("sec_ord")], k).select("qid", "section", "score", "rank")


def _section_texts(nodes: DataFrame) -> DataFrame:
    body = F.when(F.col("node_type") == "pair", F.concat_ws(":", "key", "value")).when(F.col("node_type") == "provenance", None).otherwise(F.col("value"))
    n = nodes.filter("section <> ''").withColumn("top", F.substring_index("section", "/", 1)).withColumn("body", F.when(F.col("node_type") == "section", None).otherwise(body))
    first = F.min_by("value", "ord").alias("source")
    src = n.filter("node_type = 'provenance'").groupBy("top").agg(first)
    g = n.groupBy("top").agg(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("ord", "body")))).alias("s"), F.min("ord").alias("sec_ord"))
    return g.join(src, "top", "left").select(F.col("top").alias("section"), F.array_join(F.transform("s", lambda x: x["body"]), "\n").alias("text"), "sec_ord", F.coalesce("source", F.lit("")).alias("source"))
