"""Compression, indexes, signs, synonyms, fingerprints and file quality; parts stand in for fields and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.functions import text as T
from lorespark.operators import analytics as A
from lorespark.operators import compress as C
from lorespark.plans.base import table, view
from lorespark.sources import documents as D


@query("preset_decisions", """
WITH f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'IDENTIFIER' ELSE 'NOTE' END AS key, p_name || ' or so' AS value, p_retailprice % 1 AS salience FROM part), p AS (SELECT * FROM (VALUES ('aggressive', 0.6, true), ('balanced', 0.3, false), ('conservative', 0.0, false)) t(name, low, short))
SELECT name, p_partkey, CASE WHEN key = 'IDENTIFIER' OR salience >= low THEN 'include' WHEN short AND salience >= low * 0.5 THEN 'abbreviate' ELSE 'drop' END AS decision FROM f, p""")
def preset_decisions(spark, d):
    f = view(spark, d, "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'IDENTIFIER' ELSE 'NOTE' END AS key, concat(p_name, ' or so') AS value, p_retailprice % 1 AS salience FROM part")
    each = F.array(*[F.struct(F.lit(n).alias("name"), C.field_decision(F.col("key"), F.col("value"), F.col("salience"), p).alias("decision")) for n, p in C.PRESETS.items()])
    return f.select("p_partkey", F.inline(each)).select("name", "p_partkey", "decision")


@query("entity_budgets", "SELECT c_nationkey, CAST(greatest(floor(50000 / 10.0 * (n / sum(n) OVER ())), 15) AS BIGINT) AS budget FROM (SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1)")
def entity_budgets(spark, d):
    e = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("salience"))
    return C.entity_budgets(e, C.preset("balanced"), 50_000).select("c_nationkey", "budget")


@query("inferred_marks", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '@ENTITY-' || p_brand || '(1:N(inferred))' ELSE p_name || '(inferred)' END AS marked FROM part")
def inferred_marks(spark, d):
    v = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@ENTITY-"), "p_brand", F.lit("(1:N)"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", C.inferred_mark(v).alias("marked"))


NODES = "SELECT p_brand AS doc, p_partkey AS ord, 1 AS depth, concat('ENTITY-', upper(p_type)) AS section, CASE p_size % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'line' ELSE 'pair' END AS node_type, concat('KEY-', p_size) AS key, concat(p_name, CASE WHEN p_size % 5 = 0 THEN ' required PII of @ENTITY-ORDER' ELSE '' END) AS value FROM part"


@query("node_words", """
WITH n AS (SELECT p_brand AS doc, CASE p_size % 4 WHEN 0 THEN 's' WHEN 1 THEN 'l' ELSE 'p' END AS t, len(string_split(p_name, ' ')) + CASE WHEN p_size % 5 = 0 THEN 4 ELSE 0 END AS w FROM part)
SELECT doc, CAST(sum(CASE WHEN t = 's' THEN 1 ELSE w END) AS BIGINT) AS serialised, CAST(sum(CASE t WHEN 's' THEN 1 WHEN 'p' THEN w + 1 ELSE w END) AS BIGINT) AS tree FROM n GROUP BY 1""")
def node_words(spark, d):
    return C.node_words(view(spark, d, NODES))


@query("keyword_index", """
WITH n AS (SELECT p_brand AS doc, 'ENTITY-' || upper(p_type) AS section, upper(p_type) AS own, p_size % 4 >= 2 AS pair, p_size % 5 = 0 AS term, 'key-' || p_size AS k FROM part),
t AS (SELECT doc, section, lower(own) AS w FROM n UNION SELECT doc, section, k FROM n WHERE pair UNION SELECT doc, section, unnest(['required', 'pii', 'order']) FROM n WHERE term)
SELECT doc, section AS key, array_to_string(list_slice(list(w ORDER BY w), 1, 15), ',') AS value FROM t GROUP BY 1, 2""")
def keyword_index(spark, d):
    return D.indexes(view(spark, d, NODES)).filter("index = 'KEYWORD-INDEX'").drop("index")


@query("operator_scan", """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'arrow,conjunction' WHEN 1 THEN 'conflict,magic,arrow' ELSE 'equivalence,negation' END AS kinds FROM customer""")
def operator_scan(spark, d):
    k = F.col("c_custkey") % 3
    t = F.when(k == 0, F.concat(F.lit("a -> `x | y` b+ "), "c_mktsegment", F.lit(" `!"))).when(k == 1, F.lit("CONFLICT: $CTX →")).otherwise(F.lit("x === y !z"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.operators(t), ",").alias("kinds"))


@query("semantic_keywords", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(CASE p_size % 3 WHEN 0 THEN 'PII is Encrypted, not pci_dss' WHEN 1 THEN 'required-unique ' || p_name ELSE 'inactive and Active encrypt' END, '(?i)\\b(retention|churn|pii|pci[-_]?dss|gdpr|immutable|nullable|cascade|encrypted?|confidential|restricted|active|inactive|archived|deleted|pending|approved|unique|required|mandatory)\\b'), lambda x: lower(x)))), ',') AS terms FROM part""")
def semantic_keywords(spark, d):
    t = F.when(F.col("p_size") % 3 == 0, "PII is Encrypted, not pci_dss").when(F.col("p_size") % 3 == 1, F.concat(F.lit("required-unique "), "p_name")).otherwise("inactive and Active encrypt")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.semantic_keywords(t), ",").alias("terms"))


@query("catalogue_size", "SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS n FROM documents")
def catalogue_size(spark, d):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, "# One\n1. x\n### Two").when(k == 1, "[A-1] x\n[B]\n2. y\n[C]").when(k == 2, "see\n12. item\n 3. no").otherwise("")
    return table(spark, d, "documents").select("doc_id", T.catalogue_size(t).alias("n"))


@query("truncated", "SELECT doc_id, CASE WHEN greatest(1, length(text) // 4) <= 120 THEN text ELSE text[1:483] || chr(10) || '[truncated ' || (length(text) - 483) || ' characters to fit]' END AS body FROM documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 120).alias("body"))


@query("synonyms", """
WITH s AS (SELECT DISTINCT p_name AS term, lower(p_brand) || CASE p_size % 3 WHEN 0 THEN '.metrics.' WHEN 1 THEN '.dimensions.' ELSE '.other.' END || lower(p_type) AS c FROM part), e AS (SELECT DISTINCT 'METRIC-' || upper(p_brand) || '-' || p_type AS entity FROM part WHERE p_size > 25)
SELECT DISTINCT entity, term FROM s JOIN e ON entity = 'METRIC-' || upper(split_part(c, '.', 1)) || '-' || upper(split_part(c, '.', 3)) WHERE split_part(c, '.', 2) = 'metrics'""")
def synonyms(spark, d):
    s = view(spark, d, "SELECT p_name AS term, concat(lower(p_brand), CASE p_size % 3 WHEN 0 THEN '.metrics.' WHEN 1 THEN '.dimensions.' ELSE '.other.' END, lower(p_type)) AS canonical FROM part")
    return A.synonym_aliases(s, view(spark, d, "SELECT concat('METRIC-', upper(p_brand), '-', p_type) AS entity FROM part WHERE p_size > 25"))


@query("shared_fingerprints", "SELECT p_type AS key, p_size AS signature, arg_min(p_brand, p_partkey) AS holder, coalesce(array_to_string((list(p_brand ORDER BY p_partkey))[2:], ','), '') AS others FROM part GROUP BY 1, 2")
def shared_fingerprints(spark, d):
    return A.shared_fingerprints(view(spark, d, "SELECT p_brand AS holder, p_type AS key, p_size AS signature, p_partkey AS ord FROM part"))


FILES = "SELECT concat('src/', CASE p_partkey % 3 WHEN 0 THEN 'test_' ELSE '' END, 'm', p_partkey DIV 3, '.py') AS path, CASE p_size % 3 WHEN 0 THEN concat('def f(a=(1, 2)):\\n    pass\\ndef _g(): 1\\ndef h() -> int: 1', repeat('\\n#', p_size * 20)) ELSE 'x = 1' END AS text FROM part"


@query("file_quality", """
WITH f AS (SELECT p_partkey % 3 AS k, p_partkey // 3 AS m, p_size FROM part), g AS (SELECT 'src/' || CASE WHEN k = 0 THEN 'test_' ELSE '' END || 'm' || m || '.py' AS path, k, m, p_size FROM f)
SELECT path, 'long_file' AS "check", CAST(4 + p_size * 20 AS INTEGER) AS n FROM g WHERE p_size % 3 = 0 AND 4 + p_size * 20 > 500
UNION ALL SELECT path, 'no_return_type', 1 FROM g WHERE p_size % 3 = 0 UNION ALL SELECT path, 'no_test', 1 FROM g WHERE k <> 0 AND m NOT IN (SELECT m FROM f WHERE k = 0)""")
def file_quality(spark, d):
    return A.file_quality(view(spark, d, FILES))


@query("commit_types", """
WITH l AS (SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'fix(core): x' WHEN 'O' THEN 'feat: y' ELSE 'Update z' END AS line FROM orders ORDER BY o_orderkey DESC LIMIT 30)
SELECT split_part(split_part(line, ':', 1), '(', 1) AS prefix, count(*) AS n FROM l WHERE line LIKE '%: %' GROUP BY 1 ORDER BY n DESC, prefix LIMIT 8""")
def commit_types(spark, d):
    """The commonest types of the last 30 commits (a top-k report)."""
    lines = view(spark, d, "SELECT o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'fix(core): x' WHEN 'O' THEN 'feat: y' ELSE 'Update z' END AS line FROM orders")
    return A.commit_conventions(lines)[1]


@query("centrality_text", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '0' ELSE printf('%.6f', s_acctbal / 99991.7) END AS centrality FROM supplier")
def centrality_text(spark, d):
    s = table(spark, d, "supplier")
    scores = s.filter("s_acctbal >= 0").select("s_suppkey", (F.col("s_acctbal") / 99991.7).alias("score"))
    return s.join(scores, "s_suppkey", "left").select("s_suppkey", F.when(F.col("score").isNotNull(), F.format_string("%.6f", "score")).otherwise("0").alias("centrality"))
