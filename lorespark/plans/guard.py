"""Guard, intent, validation and listing queries, mostly over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.operators import guard as G
from lorespark.plans.base import table, view


def _or(column: str, phrases: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases.split("|")) + ")"


WEAK = "not found in context|not enough information|cannot fully answer|don''t have enough|do not have enough|based on the available context|not available in the|insufficient context|need more context|no information about|not specified in|cannot determine|unable to determine|(error:"


@query("weak_answers", f"WITH t AS (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' I Cannot Determine it' WHEN 1 THEN ' (error: none)' ELSE '' END AS text FROM conversations) SELECT conv_id, turn, trim(coalesce(text, '')) = '' OR {_or('lower(text)', WEAK)} AS weak FROM t")
def weak_answers(spark, d):
    t = view(spark, d, "SELECT conv_id, turn, concat(text, CASE turn % 5 WHEN 0 THEN ' I Cannot Determine it' WHEN 1 THEN ' (error: none)' ELSE '' END) AS text FROM conversations")
    return t.select("conv_id", "turn", G.needs_more(F.col("text")).alias("weak"))


@query("catalog_intent", f"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'What entities  do we have ' WHEN 1 THEN 'How MANY ' ELSE '' END || text AS text FROM conversations)
SELECT conv_id, turn, trim(text) <> '' AND ({_or('lower(text)', 'how many|list all|total|every|all the|overview|full list|complete list|please')} OR regexp_matches(lower(text), 'what\\s+entities\\s+do\\s+we\\s+have')) AS listing FROM t""")
def catalog_intent(spark, d):
    t = view(spark, d, "SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN 'What entities  do we have ' WHEN 1 THEN 'How MANY ' ELSE '' END, text) AS text FROM conversations")
    return t.select("conv_id", "turn", G.is_catalog_query(F.col("text"), ("please",)).alias("listing"))


SAID = "CASE turn % 4 WHEN 0 THEN ' see ENTITY-USER, ENTITY-ROW-A and AB-12' WHEN 1 THEN ' Generally speaking, typically in ABCD-7' WHEN 2 THEN ' ENTITY-USER has AB-12' ELSE '' END"


@query("context_guard", f"""
WITH t AS (SELECT conv_id, turn, text || {SAID} AS a FROM conversations),
s AS (SELECT conv_id, turn, {" + ".join(f"contains(lower(a), '{p}')::INT" for p in ("not found in", "from industry experience", "based on my training", "generally speaking", "typically in"))} AS signals,
  len(list_filter(list_distinct(regexp_extract_all(a, '\\bENTITY-[A-Z][A-Z0-9-]+\\b')), lambda x: x <> 'ENTITY-USER' AND x <> 'AB-12')) + len(list_filter(list_distinct(regexp_extract_all(a, '\\b[A-Z]{{2,3}}-[0-9]+\\b')), lambda x: x <> 'ENTITY-USER' AND x <> 'AB-12')) AS unknown FROM t)
SELECT conv_id, turn, signals, unknown, CASE WHEN unknown >= 2 THEN 'new_session' WHEN unknown = 1 THEN 'retry' WHEN signals > 0 THEN 'warn' ELSE 'ok' END AS advice FROM s""")
def context_guard(spark, d):
    t = view(spark, d, f"SELECT conv_id, turn, concat(text, {SAID}) AS a FROM conversations")
    g = G.guard(t, "a", F.array(F.lit("ENTITY-USER"), F.lit("AB-12")))
    return g.select("conv_id", "turn", F.size("signals").alias("signals"), F.size("unknown").alias("unknown"), "advice")


@query("validation", """
SELECT doc_id, concat_ws(',', CASE WHEN trim(coalesce(text, '')) = '' THEN 'E001:text' END, CASE WHEN trim(coalesce(lang, '')) = '' THEN 'E001:lang' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'E001:source' END, CASE WHEN n_chars <> length(text) THEN 'E004:n_chars' END, CASE WHEN n_chars > 10000 THEN 'W001:long' END) AS diagnostics FROM documents""")
def validation(spark, d):
    doc = table(spark, d, "documents")
    req = G.missing_required(doc, {"text": F.col("text"), "lang": F.col("lang"), "source": F.col("source")}, "E001")
    all_ = F.concat_ws(",", F.nullif(req, F.lit("")), F.when(F.col("n_chars") != F.length("text"), "E004:n_chars"), F.when(F.col("n_chars") > 10000, "W001:long"))
    return doc.select("doc_id", all_.alias("diagnostics"))


@query("catalog_summary", """
WITH n AS (SELECT CASE p_size % 3 WHEN 0 THEN 'PR' WHEN 1 THEN 'STD' ELSE 'LARGE' END || '-' || p_partkey AS name FROM part) SELECT CASE WHEN regexp_extract(name, '^([A-Z]{2,3})-', 1) = '' THEN 'OTHER' ELSE regexp_extract(name, '^([A-Z]{2,3})-', 1) END AS prefix, count(*) AS n FROM n GROUP BY ROLLUP (1)""")
def catalog_summary(spark, d):
    return G.prefix_catalog(view(spark, d, "SELECT concat(CASE p_size % 3 WHEN 0 THEN 'PR' WHEN 1 THEN 'STD' ELSE 'LARGE' END, '-', p_partkey) AS name FROM part"), "name")


NAMES = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN upper(p_type) ELSE p_name END AS name, p_size % 3 <> 0 AS fn, p_size % 5 < 3 AS jsx, CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'type' WHEN 2 THEN 'function' ELSE 'const' END AS w FROM part"


@query("symbol_kinds", f"""
WITH n AS ({NAMES.format(a="'use' || upper(p_type)", b="upper(p_name[1]) || p_name[2:]")}) SELECT p_partkey, CASE WHEN w IN ('class', 'type') THEN w WHEN w = 'const' AND jsx AND regexp_matches(name, '^[A-Z]') THEN 'component'
  WHEN (fn OR w = 'function') AND regexp_matches(name, '^use[A-Z]') THEN 'hook' WHEN jsx AND regexp_matches(name, '^[A-Z]') THEN 'component' ELSE w END AS kind FROM n""")
def symbol_kinds(spark, d):
    n = view(spark, d, NAMES.format(a="concat('use', upper(p_type))", b="concat(upper(substring(p_name, 1, 1)), substring(p_name, 2))"))
    return n.select("p_partkey", G.classify_symbol(F.col("name"), F.col("fn") | (F.col("w") == "function"), F.col("jsx"), F.col("w")).alias("kind"))


@query("frameworks", """
SELECT DISTINCT p_brand, CASE WHEN p_type = 'PROMO' THEN 'web' WHEN p_type = 'STANDARD' THEN 'orm' END AS framework FROM part WHERE p_type IN ('PROMO', 'STANDARD')""")
def frameworks(spark, d):
    return G.detect_frameworks(view(spark, d, "SELECT p_brand, p_type FROM part"), "p_brand", "p_type", {"web": "promo", "orm": "standard"})
