"""Resolution, contradictions and salience, over entities made of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.functions import text as T
from lorespark.operators import resolve as R
from lorespark.plans.base import table, view

ALIASES = "SELECT * FROM VALUES ('building', 'CONSTRUCTION'), ('AUTO', 'AUTOMOBILE'), ('house hold', 'HOUSEHOLD'), ('MACHINE', 'MACHINERY') AS t(alias, target)"


@query("alias_resolve", """
WITH a(alias, target) AS (VALUES ('BUILDING', 'CONSTRUCTION'), ('AUTO', 'AUTOMOBILE'), ('HOUSE-HOLD', 'HOUSEHOLD'), ('MACHINE', 'MACHINERY')),
n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) || 'S' WHEN 1 THEN upper(c_mktsegment) ELSE 'MACHINES' END AS n FROM customer)
SELECT c_custkey, coalesce(x.target, y.target, n) AS canonical FROM n LEFT JOIN a x ON x.alias = n LEFT JOIN a y ON length(n) > 2 AND n LIKE '%S' AND y.alias = n[:-2]""")
def alias_resolve(spark, d):
    e = view(spark, d, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('entity_', c_mktsegment, 's') WHEN 1 THEN c_mktsegment ELSE 'machines' END AS name FROM customer")
    return R.resolve_aliases(e, spark.sql(ALIASES)).select("c_custkey", "canonical")


@query("canonical_names", "SELECT p_partkey, upper(replace(p_name, ' ', '-')) AS canonical FROM part")
def canonical_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.canonical_name(F.concat(F.lit(" entity-"), "p_name")).alias("canonical"))


@query("entity_merge", """
SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS aliases, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS sources, max_by(p_name, p_partkey) AS annotation, max(p_retailprice) AS salience FROM part GROUP BY 1""")
def entity_merge(spark, d):
    e = table(spark, d, "part").select("p_brand", "p_partkey", F.array("p_type").alias("aliases"), F.col("p_partkey").cast("string").alias("source"), F.col("p_name").alias("annotation"), F.col("p_retailprice").alias("salience"))
    m = R.merge_entities(e, "p_brand", "p_partkey")
    return m.select("p_brand", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", ",").alias("sources"), "annotation", "salience")


@query("dedup_exact", """
SELECT lang, sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, coalesce(array_to_string(list_slice(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id), 2, 1000000), ','), '') AS later FROM documents GROUP BY 1, 2""")
def dedup_exact(spark, d):
    """Documents by language and digest: the texts themselves are never shuffled."""
    f = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("digest"), "doc_id", F.col("doc_id").cast("string").alias("source"), F.lit("").alias("value"), F.lit(1.0).alias("salience"))
    m = R.dedup_fields(f, ["lang", "digest"], "doc_id")
    return m.select("lang", "digest", "doc_id", (F.size("additional_sources") + 1).cast("long").alias("copies"), F.array_join("additional_sources", ",").alias("later"))


@query("inverse_relationships", """
WITH r AS (SELECT DISTINCT 'CUSTOMER-' || c_nationkey AS source, 'NATION-' || c_nationkey AS target, 'belongs-to' AS rel_type, c_nationkey % 2 = 0 AS cascade FROM customer
 UNION ALL SELECT 'NATION-' || n_nationkey, 'CUSTOMER-' || n_nationkey, 'has-many', false FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'REGION-' || n_regionkey, 'NATION-' || n_nationkey, 'has-many', true FROM nation UNION ALL SELECT 'NATION-1', 'NOWHERE', 'belongs-to', false),
e AS (SELECT 'CUSTOMER-' || n_nationkey AS name FROM nation UNION ALL SELECT 'NATION-' || n_nationkey FROM nation),
i AS (SELECT target AS source, source AS target, CASE rel_type WHEN 'belongs-to' THEN 'has-many' ELSE 'belongs-to' END AS rel_type, CASE rel_type WHEN 'belongs-to' THEN '1:N' ELSE '1:1' END AS cardinality, CASE rel_type WHEN 'belongs-to' THEN cascade ELSE false END AS cascade FROM r)
SELECT source, target, rel_type, cardinality, bool_or(cascade) AS cascade, 'inferred' AS certainty FROM i WHERE source IN (SELECT name FROM e) AND (source, target, rel_type) NOT IN (SELECT (source, target, rel_type) FROM r) GROUP BY ALL""")
def inverse_relationships(spark, d):
    rels = view(spark, d, """
        SELECT DISTINCT concat('CUSTOMER-', c_nationkey) AS source, concat('NATION-', c_nationkey) AS target, 'belongs-to' AS rel_type, c_nationkey % 2 = 0 AS cascade FROM customer
        UNION ALL SELECT concat('NATION-', n_nationkey), concat('CUSTOMER-', n_nationkey), 'has-many', false FROM nation WHERE n_nationkey % 3 = 0
        UNION ALL SELECT concat('REGION-', n_regionkey), concat('NATION-', n_nationkey), 'has-many', true FROM nation UNION ALL SELECT 'NATION-1', 'NOWHERE', 'belongs-to', false""")
    names = view(spark, d, "SELECT concat('CUSTOMER-', n_nationkey) AS name FROM nation UNION ALL SELECT concat('NATION-', n_nationkey) FROM nation")
    return R.inverse_relationships(rels, names)


@query("retention_conflicts", """
WITH r AS (SELECT p_brand AS g, p_partkey AS entity, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size * 12 END AS m FROM part), f AS (SELECT g, m, min(entity) AS entity FROM r GROUP BY 1, 2)
SELECT a.g, a.entity AS entity_a, b.entity AS entity_b, a.m AS value_a, b.m AS value_b FROM f a JOIN f b ON a.g = b.g AND a.entity < b.entity AND a.m <> b.m""")
def retention_conflicts(spark, d):
    p = view(spark, d, "SELECT p_brand AS g, p_partkey AS ord, p_partkey AS entity, concat(p_size, CASE WHEN p_size % 2 = 0 THEN '-months' ELSE ' Years' END) AS v FROM part")
    return R.pair_conflicts(p.withColumn("m", T.months(F.col("v"))), ["g"], "m", "ord").select("g", "entity_a", "entity_b", "value_a", "value_b")


@query("type_conflicts", """
WITH f AS (SELECT p_name AS field, p_type AS t, min(p_partkey) AS entity FROM part GROUP BY 1, 2)
SELECT a.field, a.entity AS entity_a, b.entity AS entity_b, a.t AS value_a, b.t AS value_b FROM f a JOIN f b ON a.field = b.field AND a.entity < b.entity AND a.t <> b.t""")
def type_conflicts(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("field"), F.col("p_type").alias("t"), F.col("p_partkey").alias("entity"), F.col("p_partkey").alias("ord"))
    return R.pair_conflicts(rows, ["field"], "t", "ord").select("field", "entity_a", "entity_b", "value_a", "value_b")


@query("pii_conflicts", """
WITH l AS (SELECT c_nationkey, c_custkey, unnest([{'f': 'email', 'l': CASE WHEN c_acctbal < 0 THEN 'RESTRICTED' ELSE 'PUBLIC' END}, {'f': 'phone', 'l': c_mktsegment}]) AS x FROM customer), f AS (SELECT c_nationkey, x.f AS field, x.l AS l, min(c_custkey) AS e FROM l GROUP BY ALL)
SELECT a.c_nationkey, a.field, a.e AS entity_a, b.e AS entity_b, a.l AS value_a, b.l AS value_b FROM f a JOIN f b USING (c_nationkey, field) WHERE a.e < b.e AND a.l <> b.l""")
def pii_conflicts(spark, d):
    c = view(spark, d, "SELECT c_nationkey, c_custkey AS entity, concat('email→', CASE WHEN c_acctbal < 0 THEN 'RESTRICTED' ELSE 'PUBLIC' END, '+phone→', c_mktsegment) AS pii FROM customer")
    pairs = c.select("c_nationkey", "entity", F.col("entity").alias("ord"), F.explode(F.regexp_extract_all("pii", F.lit("([a-z]+→[A-Za-z]+)"), 1)).alias("p"))
    rows = pairs.select("c_nationkey", "entity", "ord", F.substring_index("p", "→", 1).alias("field"), F.substring_index("p", "→", -1).alias("level"))
    return R.pair_conflicts(rows, ["c_nationkey", "field"], "level", "ord").select("c_nationkey", "field", "entity_a", "entity_b", "value_a", "value_b")


@query("null_policy_conflicts", """
SELECT DISTINCT s_nationkey AS entity, c_mktsegment AS field FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000 AND c_acctbal < 0""")
def null_policy_conflicts(spark, d):
    ids = view(spark, d, "SELECT s_nationkey AS entity, c_mktsegment AS field, s_acctbal > 5000 AS required FROM supplier JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
    return R.null_policy_conflicts(ids, view(spark, d, "SELECT c_nationkey AS entity, c_mktsegment AS field, c_acctbal < 0 AS nullable FROM customer"))


@query("conditional_conflicts", """
WITH c AS (SELECT o_custkey AS g, o_orderkey AS entity, CASE WHEN o_orderstatus = 'F' THEN 'not ' ELSE '' END || lower(o_orderpriority) AS guard FROM orders), f AS (SELECT g, guard, min(entity) AS e FROM c GROUP BY 1, 2)
SELECT a.g, a.e AS entity_a, b.e AS entity_b, a.guard AS value_a, b.guard AS value_b FROM f a JOIN f b ON a.g = b.g AND a.e < b.e AND (a.guard = 'not ' || b.guard OR b.guard = 'not ' || a.guard)""")
def conditional_conflicts(spark, d):
    rows = view(spark, d, "SELECT o_custkey AS g, o_orderkey AS entity, o_orderkey AS ord, concat(CASE WHEN o_orderstatus = 'F' THEN 'not ' ELSE '' END, lower(o_orderpriority)) AS guard FROM orders")
    return R.pair_conflicts(rows, ["g"], "guard", "ord", R.opposing(F.col("value_a"), F.col("value_b"))).select("g", "entity_a", "entity_b", "value_a", "value_b")


@query("version_conflicts", """
WITH f AS (SELECT o_custkey AS g, year(o_orderdate) AS version, min_by(o_orderpriority, o_orderkey) AS v, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT a.g, a.version AS version_a, b.version AS version_b, a.v AS value_a, b.v AS value_b FROM f a JOIN f b ON a.g = b.g AND a.k < b.k AND a.v <> b.v""")
def version_conflicts(spark, d):
    """The first value of every version, paired where they differ."""
    f = view(spark, d, "SELECT o_custkey AS g, CAST(year(o_orderdate) AS BIGINT) AS version, min_by(o_orderpriority, o_orderkey) AS v, min(o_orderkey) AS k FROM orders GROUP BY 1, 2")
    a, b = f.toDF("g", "version_a", "value_a", "ka"), f.toDF("g", "version_b", "value_b", "kb")
    return a.join(b, "g").filter("ka < kb AND value_a <> value_b").select("g", "version_a", "version_b", "value_a", "value_b")


@query("metric_conflicts", """
SELECT p_name AS short_name, count(DISTINCT p_type) AS formulas, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS domains FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def metric_conflicts(spark, d):
    return R.metric_conflicts(table(spark, d, "part").select(F.col("p_name").alias("short_name"), F.col("p_type").alias("formula"), F.col("p_brand").alias("domain")))


@query("entity_salience", """
WITH s AS (SELECT s_nationkey AS n, count(*) AS sources FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS n, count(*) AS xrefs FROM customer GROUP BY 1), w AS (SELECT c_nationkey AS n, count(*) AS warnings FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
e AS (SELECT n_name AS name, n_nationkey, greatest((coalesce(sources, 0) + 2.0 * coalesce(xrefs, 0) + 1.5 * coalesce(warnings, 0)) * CASE WHEN n_regionkey = 1 THEN 1.5 ELSE 1 END, 1) AS salience FROM nation LEFT JOIN s ON s.n = n_nationkey LEFT JOIN c ON c.n = n_nationkey LEFT JOIN w ON w.n = n_nationkey)
SELECT name, CAST(salience AS DOUBLE) AS salience, row_number() OVER (ORDER BY salience DESC, n_nationkey) AS place FROM e""")
def entity_salience(spark, d):
    e = view(spark, d, """
        SELECT n_name AS name, n_nationkey, n_regionkey = 1 AS golden, coalesce(sources, 0) AS sources, coalesce(xrefs, 0) AS xrefs, coalesce(warnings, 0) AS warnings FROM nation
        LEFT JOIN (SELECT s_nationkey AS n1, count(*) AS sources FROM supplier GROUP BY 1) ON n1 = n_nationkey LEFT JOIN (SELECT c_nationkey AS n2, count(*) AS xrefs FROM customer GROUP BY 1) ON n2 = n_nationkey
        LEFT JOIN (SELECT c_nationkey AS n3, count(*) AS warnings FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1) ON n3 = n_nationkey""")
    s = R.entity_salience(e)
    s.createOrReplaceTempView("salient_")
    return spark.sql("SELECT name, CAST(salience AS DOUBLE) AS salience, row_number() OVER (ORDER BY salience DESC, n_nationkey) AS place FROM salient_")


FIELDS = "SELECT p_partkey, p_size, CASE WHEN p_size % 10 = 5 THEN '★GOLDEN-SOURCE' WHEN p_size % 5 = 0 THEN '★NOTE' WHEN p_size % 4 = 0 THEN 'IDENTIFIER' WHEN p_size % 4 = 1 THEN 'BELONGS-TO' ELSE upper(p_type) END AS key, CASE WHEN p_size % 13 = 0 THEN ' Enabled ' ELSE concat(CASE WHEN p_size % 7 = 0 THEN '⚠ ' ELSE '' END, p_name, ' and more', CASE WHEN p_size % 3 = 0 THEN ' ±30d' ELSE '' END, CASE WHEN p_size % 11 = 0 THEN ' only-if(active)' ELSE '' END) END AS value FROM part"


@query("field_budget", """
WITH f AS (SELECT p_partkey, p_size % 10 = 5 AS golden, p_size % 5 = 0 AS star, p_size % 4 AS k4, p_size % 13 = 0 AS flag, p_size AS s FROM part),
g AS (SELECT *, round((CASE WHEN star THEN 2.0 ELSE 1 END) * (CASE WHEN s % 7 = 0 AND NOT flag THEN 1.5 ELSE 1 END) * (CASE WHEN star THEN 1 WHEN k4 = 0 THEN 1.3 WHEN k4 = 1 THEN 1.2 ELSE 1 END) * (CASE WHEN s % 3 = 0 AND NOT flag THEN 1.1 ELSE 1 END) * (CASE WHEN s % 11 = 0 AND NOT flag THEN 1.3 ELSE 1 END), 6)::DOUBLE AS salience FROM f)
SELECT p_partkey, salience, CASE WHEN golden OR flag OR (k4 = 0 AND NOT star) OR salience >= 2.0 THEN 'include' WHEN salience >= 1.0 THEN 'abbreviate' ELSE 'drop' END AS decision FROM g""")
def field_budget(spark, d):
    f = view(spark, d, FIELDS)
    s = f.withColumn("salience", F.round(R.field_salience(F.col("key"), F.col("value")), 6))
    keep = R.must_preserve(F.col("key"), F.col("value"))
    return s.select("p_partkey", "salience", R.budget_decision(keep, F.col("salience"), 2.0).alias("decision"))


@query("abbreviate", """
WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || ' | ' || p_type WHEN 1 THEN p_name || '→' || p_type WHEN 2 THEN p_name || ', ' || p_type ELSE p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type END AS v FROM part)
SELECT p_partkey, CASE WHEN v LIKE '%|%' THEN trim(split_part(v, '|', 1)) || '…' WHEN v LIKE '%→%' THEN trim(split_part(v, '→', 1)) || '…' WHEN v LIKE '%,%' THEN trim(split_part(v, ',', 1)) || '…' WHEN length(v) > 40 THEN v[1:37] || '…' ELSE v END AS short FROM v""")
def abbreviate(spark, d):
    v = view(spark, d, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_name, ' | ', p_type) WHEN 1 THEN concat(p_name, '→', p_type) WHEN 2 THEN concat(p_name, ', ', p_type) ELSE concat(p_name, ' ', p_type, ' ', p_brand, ' ', p_name, ' ', p_type) END AS v FROM part")
    return v.select("p_partkey", T.abbreviated(F.col("v")).alias("short"))


@query("schema_prefix_match", """
WITH s(schema_name, schema_ord) AS (VALUES ('STANDARD', 3), ('STAND', 1), ('PROMO', 2), ('ECON', 4), ('LARGE', 5), ('S', 6)), m AS (SELECT p_partkey, p_type, schema_name, row_number() OVER (PARTITION BY p_partkey ORDER BY schema_name <> p_type, schema_ord) AS k FROM part JOIN s ON starts_with(p_type, schema_name))
SELECT p_partkey, p_type, schema_name FROM m WHERE k = 1""")
def schema_prefix_match(spark, d):
    s = spark.sql("SELECT * FROM VALUES ('STANDARD', 3), ('STAND', 1), ('PROMO', 2), ('ECON', 4), ('LARGE', 5), ('S', 6) AS t(schema_name, schema_ord)")
    return R.prefix_match(table(spark, d, "part").select("p_partkey", "p_type"), s, "p_type")


@query("qualified_names", """
SELECT p_partkey, p_name || CASE WHEN k = 0 THEN '' ELSE '#' || k END AS qname FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)""")
def qualified_names(spark, d):
    return R.qualified_names(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "qname")


@query("reference_counts", "SELECT 'C-' || o_custkey AS entity, count(*) AS refs FROM orders GROUP BY 1")
def reference_counts(spark, d):
    return R.reference_counts(view(spark, d, "SELECT concat('placed by @ENTITY-C-', o_custkey, ' (', o_orderstatus, ')') AS v FROM orders"), "v")


@query("filler_words", f"""
WITH w AS (SELECT doc_id, text, list_filter(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x: NOT list_contains([{", ".join(repr(f) for f in T.FILLERS)}], lower(regexp_replace(x, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')))) AS kept FROM documents)
SELECT doc_id, md5(CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE text END) AS digest FROM w""")
def filler_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.without_fillers(F.col("text"))).alias("digest"))


@query("dehyphenate", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'well known' ELSE 'x 10-20' END || ' ' || c_mktsegment || '-AB x A @E-' || c_custkey AS value FROM customer""")
def dehyphenate(spark, d):
    v = view(spark, d, "SELECT c_custkey, concat(CASE WHEN c_custkey % 2 = 0 THEN 'well-known' ELSE 'x 10-20' END, ' ', upper(c_mktsegment), '-AB x-A @E-', c_custkey) AS v, c_mktsegment FROM customer")
    return v.select("c_custkey", F.replace(T.dehyphenated(F.col("v")), F.upper("c_mktsegment"), F.col("c_mktsegment")).alias("value"))
