"""Document-layer queries: numbering, provenance, manifests, layers, signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.functions import text as T
from lorespark.plans.base import table, view
from lorespark.plans.retrieval import WORDS
from lorespark.sources import documents as D
from lorespark.sources import markdown as M


@query("section_numbering", """
WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS lv FROM conversations),
a AS (SELECT *, count(*) FILTER (lv < 2) OVER w AS g2, count(*) FILTER (lv < 3) OVER w AS g3, count(*) FILTER (lv = 1) OVER w AS n1 FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, count(*) FILTER (lv = 2) OVER (PARTITION BY conv_id, g2 ORDER BY turn) AS n2, count(*) FILTER (lv = 3) OVER (PARTITION BY conv_id, g3 ORDER BY turn) AS n3 FROM a)
SELECT conv_id, turn, n1 || CASE WHEN lv >= 2 THEN '.' || n2 ELSE '' END || CASE WHEN lv >= 3 THEN '.' || n3 ELSE '' END AS number FROM b""")
def section_numbering(spark, d):
    h = view(spark, d, "SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations")
    return M.section_numbers(h, "conv_id", "turn", "level").select("conv_id", "turn", "number")


@query("provenance", """
WITH f AS (SELECT p_brand, p_type, p_name AS s, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT p_brand AS entity, p_type AS key, string_agg(s, ' + ' ORDER BY k, s) AS sources FROM f GROUP BY 1, 2""")
def provenance(spark, d):
    return D.provenance(table(spark, d, "part").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("key"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("source")))


@query("manifest", f"""
WITH p AS (SELECT c_nationkey, list(c_mktsegment || '-' || c_custkey ORDER BY c_custkey) AS ks, sum(len({WORDS.format(t="c_name")})) AS w FROM customer GROUP BY 1)
SELECT 'N' || c_nationkey AS section, CAST(len(ks) AS INTEGER) AS n_keys, array_to_string(ks[1:8], ',') || CASE WHEN len(ks) > 8 THEN ',+' || (len(ks) - 8) ELSE '' END AS keys, CAST(w AS BIGINT) AS words FROM p""")
def manifest(spark, d):
    n = view(spark, d, "SELECT 'd' AS doc, concat('N', c_nationkey) AS section, 'pair' AS node_type, c_custkey AS ord, concat(c_mktsegment, '-', c_custkey) AS key, c_name AS value FROM customer")
    return D.manifest(n).drop("doc")


@query("layer_filter", """
WITH s AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'inferred' WHEN 2 THEN 'ambient' ELSE 'rules' END AS layer, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 10000 END AS confidence FROM supplier)
SELECT coalesce(layer, 'rules') AS layer, count(*) AS n FROM s WHERE coalesce(layer, 'rules') IN ('rules', 'inferred') AND coalesce(confidence, 1.0) >= 0.3 GROUP BY 1""")
def layer_filter(spark, d):
    """Sections of some layers and of enough confidence; what states neither is a rule and certain."""
    s = view(spark, d, "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'inferred' WHEN 2 THEN 'ambient' ELSE 'rules' END AS layer, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 10000 END AS confidence FROM supplier")
    layer = F.coalesce("layer", F.lit("rules"))
    return s.filter(layer.isin("rules", "inferred") & (F.coalesce("confidence", F.lit(1.0)) >= 0.3)).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("constraint_density", """
SELECT o_custkey, count_if(o_orderstatus = 'F') AS warnings, CASE WHEN count_if(o_orderstatus = 'F') > 2 THEN 'high' WHEN count_if(o_orderstatus = 'F') > 1 THEN 'medium' ELSE 'low' END AS density, string_agg(o_orderpriority, ';' ORDER BY o_orderpriority, o_orderkey) AS constraints FROM orders GROUP BY 1""")
def constraint_density(spark, d):
    n = F.count_if(F.col("o_orderstatus") == "F")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", "o_orderkey"))), lambda x: x["o_orderpriority"]), ";")
    return table(spark, d, "orders").groupBy("o_custkey").agg(n.alias("warnings"), F.when(n > 2, "high").when(n > 1, "medium").otherwise("low").alias("density"), ordered.alias("constraints"))


@query("dominant_pattern", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1, 2) SELECT p_brand, p_type AS pattern, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, k) AS r FROM c) WHERE r = 1""")
def dominant_pattern(spark, d):
    c = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("k"))
    best = F.max_by(F.struct("p_type", "n"), F.struct("n", (-F.col("k")).alias("k")))
    return c.groupBy("p_brand").agg(best.alias("b")).select("p_brand", F.col("b.p_type").alias("pattern"), "b.n")


@query("ascii_forms", "SELECT c_custkey, '$CTX ' || c_name || ' -> ' || c_mktsegment || ' ##3d WARN: *** !x === CONFLICT: ≥' AS form FROM customer")
def ascii_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.ascii_form(F.concat(F.lit("§CTX "), "c_name", F.lit(" → "), "c_mktsegment", F.lit(" ±3d ⚠ ★ ¬x ≡ ⊥ ≥"))).alias("form"))


@query("search_keys", f"SELECT item_id, array_to_string(list_sort(list_distinct({WORDS.format(t='lower(text)')})), ' ') AS search_key, sha256(text) AS question_hash FROM benchmark")
def search_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.search_key(F.col("text")).alias("search_key"), F.sha2("text", 256).alias("question_hash"))


@query("identifier_tokens", """
SELECT p_partkey, 'get' || p_brand[1:5] || '_x' AS raw, lower('get' || p_brand[1:5] || '_x') || ' get brand x' AS tokens FROM part""")
def identifier_tokens(spark, d):
    raw = F.concat(F.lit("get"), F.substring("p_brand", 1, 5), F.lit("_x"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"), F.array_join(T.identifier_tokens(raw), " ").alias("tokens"))
