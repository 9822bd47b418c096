"""Entity resolution and contradictions: aliases, merging, field de-duplication, inverse relationships, conflict checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T


def resolve_aliases(entities: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``canonical``: the target of the exact alias, else of the name without a final S, else the name itself.

    ``aliases`` has (alias, target); the map comes from a configuration, and Catalyst broadcasts it when it is small.
    """
    a = aliases.select(T.canonical_name(F.col("alias")).alias("a_"), T.canonical_name(F.col("target")).alias("t_")).dropDuplicates(["a_"])
    n = T.canonical_name(F.col(name))
    singular = F.when((F.length(n) > 2) & n.endswith("S"), F.expr(f"substring({_name_sql(name)}, 1, length({_name_sql(name)}) - 1)"))
    e = entities.withColumn("n_", n).withColumn("s_", singular)
    e = e.join(a.withColumnsRenamed({"a_": "a1", "t_": "t1"}), F.col("n_") == F.col("a1"), "left").join(a.withColumnsRenamed({"a_": "a2", "t_": "t2"}), F.col("s_") == F.col("a2"), "left")
    return e.withColumn("canonical", F.coalesce("t1", "t2", "n_")).drop("n_", "s_", "a1", "t1", "a2", "t2")


def _name_sql(name: str) -> str:
    return f"regexp_replace(translate(upper(trim(`{name}`)), '_ ', '--'), '^ENTITY-', '')"


def merge_entities(entities: DataFrame, key: str, ord_: str) -> DataFrame:
    """One row for each key: the union of aliases, sources in order, the annotation of the last row, the largest salience."""
    steps = F.array_sort(F.collect_list(F.struct(ord_, "source", "annotation")))
    g = entities.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), steps.alias("s"), F.max("salience").alias("salience"))
    return g.select(key, "aliases", F.transform("s", lambda x: x["source"]).alias("sources"), F.element_at("s", -1)["annotation"].alias("annotation"), "salience")


def dedup_fields(fields: DataFrame, by: list[str], ord_: str) -> DataFrame:
    """The first of the fields with the same key and raw value, with the largest salience and the later rows' sources."""
    steps = F.array_sort(F.collect_list(F.struct(ord_, "source", "value")))
    g = fields.groupBy(*by).agg(steps.alias("s"), F.max("salience").alias("salience"))
    later = F.transform(F.slice("s", 2, 1 << 30), lambda x: x["source"])
    return g.select(*by, F.col("s")[0][ord_].alias(ord_), F.col("s")[0]["value"].alias("value"), F.col("s")[0]["source"].alias("source"), F.when(F.col("s")[0]["source"].isNotNull(), F.filter(later, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("additional_sources"), "salience")


INVERSE = (("belongs-to", "has-many", "1:N"), ("has-many", "belongs-to", "1:1"))


def inverse_relationships(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships that follow from stated ones: the target must exist and must not state the inverse itself."""
    kind = F.when(F.col("rel_type") == "belongs-to", "has-many").when(F.col("rel_type") == "has-many", "belongs-to")
    card = F.when(F.col("rel_type") == "belongs-to", "1:N").otherwise("1:1")
    inv = rels.select(F.col("target").alias("source"), F.col("source").alias("target"), kind.alias("rel_type"), card.alias("cardinality"), F.when(F.col("rel_type") == "belongs-to", F.col("cascade")).otherwise(False).alias("cascade"))
    inv = inv.filter("rel_type IS NOT NULL").join(entities.select(F.col("name").alias("source")), "source", "left_semi")
    new = inv.join(rels.select("source", "target", "rel_type"), ["source", "target", "rel_type"], "left_anti")
    return new.groupBy("source", "target", "rel_type", "cardinality").agg(F.bool_or("cascade").alias("cascade")).withColumn("certainty", F.lit("inferred"))


def first_per_value(rows: DataFrame, by: list[str], value: str, ord_: str) -> DataFrame:
    """The earliest row of every value in its group: what pairwise checks need, however many rows repeat the value."""
    w = Window.partitionBy(*by, value).orderBy(ord_)
    return rows.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")


def pair_conflicts(rows: DataFrame, by: list[str], value: str, ord_: str, differ: Column | None = None) -> DataFrame:
    """Pairs (a before b) of first rows in a group whose values differ: quadratic in distinct values only."""
    f = first_per_value(rows, by, value, ord_)
    a = f.select(*by, F.col(ord_).alias("ord_a"), F.col("entity").alias("entity_a"), F.col(value).alias("value_a"))
    b = f.select(*by, F.col(ord_).alias("ord_b"), F.col("entity").alias("entity_b"), F.col(value).alias("value_b"))
    p = a.join(b, by).filter("ord_a < ord_b")
    return p.filter(F.col("value_a") != F.col("value_b") if differ is None else differ)


def null_policy_conflicts(identifiers: DataFrame, policies: DataFrame) -> DataFrame:
    """Identifiers that are required but nullable by policy: (entity, field)."""
    req = identifiers.filter("required").select("entity", "field")
    return req.join(policies.filter("nullable").select("entity", "field"), ["entity", "field"]).distinct()


def opposing(a: Column, b: Column) -> Column:
    """One condition negates the other: ``not x``, ``!x`` or ``inx``."""
    neg = lambda x, y: (x == F.concat(F.lit("not "), y)) | (x == F.concat(F.lit("!"), y)) | (x == F.concat(F.lit("in"), y))
    return neg(a, b) | neg(b, a)


def metric_conflicts(metrics: DataFrame) -> DataFrame:
    """Metrics of one short name with several formulas: the number of formulas and the domains."""
    g = metrics.groupBy("short_name").agg(F.countDistinct("formula").alias("formulas"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    return g.filter("formulas > 1")


def entity_salience(e: DataFrame) -> DataFrame:
    """1 a source, 2 a reference, 1.5 a warning; half more with a golden source; 1 at least."""
    base = F.col("sources") + 2.0 * F.col("xrefs") + 1.5 * F.col("warnings")
    return e.withColumn("salience", F.greatest(base * F.when(F.col("golden"), 1.5).otherwise(1.0), F.lit(1.0)))


RELATIONS = ("BELONGS-TO", "HAS-MANY", "HAS-ONE", "DEPENDS-ON", "REFERENCES")


def field_salience(key: Column, value: Column) -> Column:
    """The product of what makes a field matter: a starred key, a warning, an identifying or relationship key, a time window, a guard."""
    m = F.when(key.startswith("★"), 2.0).otherwise(1.0) * F.when(value.contains("⚠"), 1.5).otherwise(1.0)
    m = m * F.when(key.isin("IDENTIFIER", "MATCH-RULES", "PII", "PII-CLASSIFICATION"), 1.3).otherwise(1.0) * F.when(key.isin(*RELATIONS), 1.2).otherwise(1.0)
    return m * F.when(value.rlike("±[0-9]+[dwm]\\b"), 1.1).otherwise(1.0) * F.when(value.rlike("\\b(?:only-if|when|if)\\([^)]+\\)"), 1.3).otherwise(1.0)


def must_preserve(key: Column, value: Column) -> Column:
    """Fields that no budget drops: the identifier, the golden source, a switch, or a single token of under 20 characters."""
    v = F.regexp_replace(value, "^\\s+|\\s+$", "")
    return key.isin("IDENTIFIER", "★GOLDEN-SOURCE") | F.lower(v).isin("true", "false", "yes", "no", "enabled", "disabled") | ((v != "") & ~v.rlike("\\s") & (F.length(v) < 20))


def budget_decision(keep: Column, salience: Column, threshold: float) -> Column:
    """include, abbreviate (from half the threshold) or drop."""
    return F.when(keep | (salience >= threshold), "include").when(salience >= threshold / 2, "abbreviate").otherwise("drop")


def prefix_match(rows: DataFrame, schemas: DataFrame, name: str) -> DataFrame:
    """Each row with the first schema that has its name, else the first whose name begins it: an equi join on all prefixes."""
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name))), lambda i: F.substring(F.col(name), F.lit(1), i))
    ex = rows.withColumn("p_", F.explode(prefixes)).join(schemas.select(F.col("schema_name").alias("p_"), "schema_ord"), "p_")
    w = Window.partitionBy(*rows.columns).orderBy((F.col("p_") != F.col(name)), "schema_ord")
    return ex.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").select(*rows.columns, F.col("p_").alias("schema_name"))


def qualified_names(rows: DataFrame, base: str, ord_: str) -> DataFrame:
    """``base`` for the first of a name, ``base#k`` for later ones."""
    k = F.row_number().over(Window.partitionBy(base).orderBy(ord_)) - 1
    return rows.withColumn("k_", k).withColumn("qname", F.when(F.col("k_") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), F.col("k_").cast("string")))).drop("k_")


def reference_counts(values: DataFrame, value: str) -> DataFrame:
    """How often each entity is referenced."""
    refs = F.regexp_extract_all(F.col(value), F.lit("@ENTITY-([A-Za-z0-9_][A-Za-z0-9_-]*)"), 1)
    return values.select(F.explode(refs).alias("entity")).groupBy("entity").agg(F.count("*").alias("refs"))
