"""Checks of answers and questions: weak answers, unknown names, catalogue intent, document and event validation, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T

WEAK = (
    "(error:", "based on the available context", "cannot determine", "cannot fully answer", "do not have enough", "don't have enough", "insufficient context", "need more context",
    "no information about", "not available in the", "not enough information", "not found in context", "not specified in", "unable to determine",
)
LOST = ("based on my training", "from industry experience", "generally speaking", "not found in", "typically in")
CATALOG = ("all the", "complete list", "every", "full list", "how many", "list all", "overview", "total")


def needs_more(answer: Column) -> Column:
    """An empty answer, or one with a phrase of not knowing."""
    return (F.trim(F.coalesce(answer, F.lit(""))) == "") | T.any_of(F.lower(answer), WEAK)


def is_catalog_query(question: Column, custom: tuple[str, ...] = (), kind: str = "entities") -> Column:
    """A question for counts, lists or an overview; an empty one is not."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return (F.trim(q) != "") & (T.any_of(q, CATALOG + tuple(p.lower() for p in custom)) | q.rlike(f"what\\s+{re.escape(kind)}\\s+do\\s+we\\s+have"))


def guard(answers: DataFrame, text: str, known: Column | None = None, custom: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``signals`` (phrases of lost context), ``unknown`` (names and ids that are not ``known``; none are where it is None) and ``advice``.

    Two unknown names call for a new session, one for another try, signals alone for a warning.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    signals = F.array_compact(F.array(*[F.when(F.lower(t).contains(p.lower()), F.lit(p)) for p in LOST + tuple(custom)]))
    found = [F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(p), 0))) for p in ("\\bENTITY-[A-Z][A-Z0-9-]+\\b", "\\b[A-Z]{2,3}-[0-9]+\\b")]
    unknown = F.array().cast("array<string>") if known is None else F.concat(*[F.filter(f, lambda x: ~F.array_contains(known, x)) for f in found])
    a = answers.withColumn("signals", signals).withColumn("unknown", unknown)
    return a.withColumn("advice", F.when(F.size("unknown") >= 2, "new_session").when(F.size("unknown") == 1, "retry").when(F.size("signals") > 0, "warn").otherwise("ok"))


def correction(advice: Column, signals: Column, unknown: Column, known: Column) -> Column:
    """What to tell the model before its next turn; empty where all was well."""
    names = F.concat(F.lit("Some names in the last answer are not in the catalogue. Use only these: "), F.array_join(F.array_sort(known), ", "))
    weak = F.lit("The last answer showed low confidence. Use only what the given context says.")
    return F.when(advice == "ok", "").when((F.size(unknown) > 0) & (F.size(known) > 0), names).when(F.size(signals) > 0, weak).otherwise("")


def missing_required(rows: DataFrame, required: dict[str, Column], code: str) -> Column:
    """A comma-joined list of diagnostics for required columns without a value."""
    return F.concat_ws(",", *[F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(f"{code}:{name}")) for name, c in required.items()])


def prefix_catalog(names: DataFrame, name: str) -> DataFrame:
    """Counts by the two- or three-letter prefix before a hyphen, OTHER for the rest, and the total (prefix null), in one pass."""
    p = F.regexp_extract(name, "^([A-Z]{2,3})-", 1)
    return names.select(F.when(p == "", "OTHER").otherwise(p).alias("prefix")).rollup("prefix").agg(F.count("*").alias("n"))


def classify_symbol(name: Column, is_function: Column, renders: Column, declared: Column) -> Column:
    """Kind of a TypeScript symbol, ``declared`` as function, const, class, type, interface or enum: a hook by its name (useX), a
    component by a capital and markup in its body (or a factory around it), else what the declaration says."""
    capital = name.rlike("^[A-Z]") & renders
    return (
        F.when(declared.isin("class"), "class").when(declared.isin("type", "interface", "enum"), "type")
        .when((declared == "const") & capital, "component").when(name.rlike("^use[A-Z]") & is_function, "hook")
        .when((declared == "function") & capital, "component").otherwise(F.when(declared == "function", "function").otherwise("const"))
    )


def detect_frameworks(imports: DataFrame, by: str, name: str, marks: dict[str, str]) -> DataFrame:
    """(by, framework): the frameworks whose mark occurs in an import of the module."""
    hits = [F.when(F.bool_or(F.lower(F.col(name)).contains(m)), F.lit(f)) for f, m in marks.items()]
    return imports.groupBy(by).agg(F.array_compact(F.array(*hits)).alias("f")).select(by, F.explode("f").alias("framework"))
