"""Markdown as rows: a state machine over lines, written as forward fills over windows so that it never leaves the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T


def lines(texts: DataFrame) -> DataFrame:
    """(path, line, text), lines from 1."""
    return texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), F.trim(F.regexp_replace("text", "\r$", "")).alias("text"))


def facts(texts: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Fields, rules, warnings and notes of Markdown files.

    A first- or second-level heading that names an entity ("Entity: NAME", or an alias) opens it and clears the field
    key. Another first-level heading closes the entity and names rules, another second-level one only sets the field key,
    as deeper headings do.
    """
    level = F.length(F.regexp_extract("text", "^(#{1,4})\\s+\\S", 1))
    title = F.regexp_replace("text", "^#{1,4}\\s+", "")
    named = F.regexp_extract(title, "(?i)^entity:\\s*(.+)$", 1)
    known = {a.lower(): c.upper() for c, own in (aliases or {}).items() for a in [*own, c]}
    alias = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.lower(title)) if known else F.lit(None).cast("string")
    entity = F.when(level.between(1, 2), F.coalesce(alias, F.when(named != "", T.canonical_name(named))))
    key = F.upper(F.regexp_replace(F.trim(title), "[\\s_]+", "-"))
    l = lines(texts).withColumn("level", level).withColumn("named", entity).withColumn("hkey", key)
    # what a heading sets: the entity ('' closes it) and the field key ('' clears it); null leaves them
    sets_entity = F.when(F.col("named").isNotNull(), F.col("named")).when(F.col("level") == 1, F.lit(""))
    sets_key = F.when(F.col("named").isNotNull(), F.lit("")).when(F.col("level") >= 1, F.col("hkey"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("entity", F.nullif(F.last(sets_entity, True).over(w), F.lit(""))).withColumn("field", F.nullif(F.last(sets_key, True).over(w), F.lit("")))
    quote = F.regexp_extract("text", "(?i)^>\\s*\\*\\*(warning|note):?\\*\\*:?\\s*(.*)$", 1)
    said = F.regexp_extract("text", "(?i)^>\\s*\\*\\*(?:warning|note):?\\*\\*:?\\s*(.*)$", 1)
    bullet = F.regexp_extract("text", "^[-*+]\\s+(.+)$", 1)
    kind = (
        F.when(F.col("level") > 0, F.when(F.col("named").isNotNull(), "entity"))
        .when(F.lower(quote) == "warning", "warning").when((F.lower(quote) == "note") & F.col("entity").isNotNull() & F.col("field").isNotNull(), "note")
        .when(bullet != "", F.when(F.col("entity").isNotNull(), "field").when(F.col("field").isNotNull(), "rule"))
        .when((F.col("text") != "") & ~F.col("text").rlike("^[>#]"), F.when(F.col("field").isNotNull(), F.when(F.col("entity").isNotNull(), "field").otherwise("rule")))
    )
    body = F.when(quote != "", said).when(bullet != "", bullet).otherwise(F.col("text"))
    l = l.withColumn("kind", kind).withColumn("body", body).filter("kind IS NOT NULL")
    value = F.when(F.col("kind").isin("field", "rule"), T.without_fillers(F.col("body"))).when(F.col("kind") == "entity", F.lit("")).otherwise(F.col("body"))
    return l.select("path", F.lit("md").alias("fmt"), "kind", F.col("entity"), F.col("line").alias("ord"), F.when(F.col("kind") == "entity", F.lit("description")).otherwise(F.coalesce("field", F.lit("NOTES"))).alias("key"), value.alias("value"), F.col("body").alias("raw"), F.lit("explicit").alias("certainty"), "line")


def section_numbers(headings: DataFrame, by: str, ord_: str, level: str, deepest: int = 4) -> DataFrame:
    """Adds ``number``: 1.2.3 counters, each level counted under its parent, deeper ones starting anew."""
    w = Window.partitionBy(by).orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0)
    h, parents = headings, []
    for k in range(1, deepest + 1):
        # the group of a level-k counter changes with every heading above it
        grp = F.count(F.when(F.col(level) < k, 1)).over(w)
        h = h.withColumn(f"g{k}", grp)
        h = h.withColumn(f"n{k}", F.count(F.when(F.col(level) == k, 1)).over(Window.partitionBy(by, f"g{k}").orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0)))
        parents.append(F.when(F.col(level) >= k, F.col(f"n{k}").cast("string")))
    return h.withColumn("number", F.concat_ws(".", *parents)).drop(*[f"{c}{k}" for c in "gn" for k in range(1, deepest + 1)])


def resolve_references(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Appends the heading to "see Section 2.3": every reference is joined with its section; (path, text) with texts of (path, ord, text)."""
    ref = "(?i)(see\\s+section\\s+)([0-9]+(?:\\.[0-9]+)*)"
    # text up to and with each reference, then the rest: pieces are joined with their sections and put together again
    marked = F.regexp_replace("text", ref, "$1$2\u0001")
    p = texts.select("path", "ord", F.posexplode(F.split(marked, "\u0001")).alias("i", "piece"))
    p = p.withColumn("number", F.regexp_extract("piece", ref + "$", 2))
    j = p.join(sections.select("path", "number", "heading"), ["path", "number"], "left")
    piece = F.concat("piece", F.when(F.col("heading").isNotNull(), F.concat(F.lit(" ("), "heading", F.lit(")"))).otherwise(F.lit("")))
    g = j.withColumn("piece", piece).groupBy("path", "ord").agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("s"))
    return g.select("path", "ord", F.array_join(F.transform("s", lambda x: x["piece"]), "").alias("text"))
