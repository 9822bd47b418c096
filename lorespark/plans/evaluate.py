"""Evaluation queries: labels are grades, event values latencies, parts questions of several runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.functions import text as T
from lorespark.operators import evaluate as E
from lorespark.plans.base import table, view
from lorespark.plans.retrieval import WORDS


@query("grade_by_group", """
WITH r AS (SELECT source, quality = 1 AS e, n_chars > 500 AS p FROM labels JOIN documents USING (doc_id))
SELECT source, count(*) AS total, count_if(e = p) AS correct, round(count_if(e = p)::DOUBLE / count(*), 9) AS score, round(count_if(e AND p)::DOUBLE / nullif(count_if(p), 0), 9) AS precision, round(count_if(e AND p)::DOUBLE / nullif(count_if(e), 0), 9) AS recall FROM r GROUP BY GROUPING SETS ((source), ())""")
def grade_by_group(spark, d):
    return E.grades(view(spark, d, "SELECT source, quality = 1 AS expected, n_chars > 500 AS predicted FROM labels JOIN documents USING (doc_id)"), "source")


FILLED = WORDS.format(t="text")
FILLERS = "'a', 'all', 'also', 'an', 'and', 'any', 'are', 'as', 'at', 'be', 'been', 'being', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'during', 'each', 'every', 'for', 'from', 'had', 'has', 'have', 'in', 'into', 'is', 'it', 'its', 'just', 'may', 'might', 'no', 'not', 'of', 'on', 'or', 'shall', 'should', 'so', 'some', 'that', 'the', 'then', 'these', 'this', 'those', 'through', 'to', 'very', 'was', 'were', 'will', 'with', 'would'"
KEPT = f"list_filter({FILLED}, lambda x: NOT list_contains([{FILLERS}], lower(regexp_replace(x, '[.,;:!?]+$', ''))))"


@query("compression_ratio", f"""
WITH k AS (SELECT lang, text, {FILLED} AS w, {KEPT} AS k FROM documents), c AS (SELECT lang, text, len(w) AS a, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS t FROM k), n AS (SELECT lang, text, a, t, len({WORDS.format(t="t")}) AS b FROM c)
SELECT lang, sum(a)::BIGINT AS source_words, sum(b)::BIGINT AS words, sum(greatest(1, length(text) // 4))::BIGINT AS source_tokens, sum(greatest(1, length(t) // 4))::BIGINT AS tokens, round(sum(a)::DOUBLE / nullif(sum(b), 0), 6) AS ratio FROM n GROUP BY 1""")
def compression_ratio(spark, d):
    return E.compression(table(spark, d, "documents"), "lang", F.col("text"), T.without_fillers(F.col("text")))


@query("latency_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return E.latency(table(spark, d, "events"), "event_type", "value")


@query("token_cost", "SELECT doc_id, round(greatest(1, length(text) // 4) / 1000.0 * CASE lang WHEN 'en' THEN 0.015 WHEN 'fr' THEN 0.0025 WHEN 'de' THEN 0.00015 ELSE 0.003 END, 9) AS cost FROM documents")
def token_cost(spark, d):
    model = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "claude-opus-4-6", "fr", "gpt-4o", "de", "gpt-4o-mini")]), F.col("lang"))
    t = table(spark, d, "documents").withColumn("tokens", T.estimated_tokens(F.col("text"))).withColumn("model", F.coalesce(model, F.lit("another")))
    return E.token_cost(t, "tokens", "model").select("doc_id", F.round("cost", 9).alias("cost"))


@query("quality_gates", """
WITH m AS (SELECT avg(quality)::DOUBLE AS quality, avg(toxic)::DOUBLE AS toxicity, count(*)::DOUBLE AS labels FROM labels)
SELECT 'quality' AS gate, round(quality, 9) AS value, quality >= 0.5 AS passed FROM m UNION ALL SELECT 'toxicity', round(toxicity, 9), toxicity <= 0.05 FROM m UNION ALL SELECT 'labels', labels, labels >= 100 FROM m""")
def quality_gates(spark, d):
    m = table(spark, d, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxicity"), F.count("*").alias("labels"))
    return E.gates(m, {"quality": (">=", 0.5), "toxicity": ("<=", 0.05), "labels": (">=", 100.0)}).withColumn("value", F.round("value", 9))


RUNS = ["PROMO", "STANDARD", "ECONOMY"]


@query("correctness_pivot", """
SELECT p_name, """ + ", ".join(f"coalesce(bool_or(p_size > 25) FILTER (p_type = '{r}'), false) AS {r}" for r in RUNS) + " FROM part GROUP BY 1")
def correctness_pivot(spark, d):
    r = table(spark, d, "part").select("p_name", "p_type", (F.col("p_size") > 25).alias("correct"))
    return E.correctness_pivot(r, "p_name", "p_type", RUNS)


@query("paired_flips", """
WITH a AS (SELECT o_orderkey AS q, o_orderpriority AS g, o_totalprice > 100000 AS c, length(o_orderstatus || o_orderpriority) AS l FROM orders), b AS (SELECT l_orderkey AS q, max(l_discount) > 0.05 AS c, count(*) AS l FROM lineitem GROUP BY 1)
SELECT g, count_if(a.c AND b.c) AS both_pass, count_if(NOT a.c AND NOT b.c) AS both_fail, count_if(a.c AND NOT b.c) AS a_wins, count_if(NOT a.c AND b.c) AS b_wins, round(avg(a.l), 6) AS len_a, round(avg(b.l), 6) AS len_b FROM a JOIN b USING (q) GROUP BY 1""")
def paired_flips(spark, d):
    a = view(spark, d, "SELECT o_orderkey AS q, o_orderpriority AS g, o_totalprice > 100000 AS correct, length(concat(o_orderstatus, o_orderpriority)) AS answer_len FROM orders")
    return E.flips(a, view(spark, d, "SELECT l_orderkey AS q, max(l_discount) > 0.05 AS correct, count(*) AS answer_len FROM lineitem GROUP BY 1"), "q", "g")


NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +', ' ', 'g'))"


@query("answer_match", f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS raw, {NORM.format(c="a.text")} AS e, {NORM.format(c="b.text")} AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT *, list_filter(string_split(e, ' '), lambda x: length(x) > 2) AS want, list_filter(string_split(a, ' '), lambda x: length(x) >= 3) AS have FROM p)
SELECT conv_id, turn, contains(a, e) OR (len(want) > 0 AND len(list_filter(want, lambda t: contains(a, t) OR len(list_filter(have, lambda h: starts_with(h, t) OR starts_with(t, h))) > 0))::DOUBLE / greatest(len(want), 1) >= 0.6) AS matches FROM w""")
def answer_match(spark, d):
    p = view(spark, d, "SELECT a.conv_id, a.turn, a.text AS expected, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
    return p.select("conv_id", "turn", E.answer_matches(F.col("answer"), F.col("expected")).alias("matches"))


@query("content_version", """
WITH d AS (SELECT sha256(CAST(doc_id AS VARCHAR) || chr(31) || text) AS d FROM documents), g AS (SELECT d[1:2] AS g, sha256(string_agg(d, '' ORDER BY d)) AS h FROM d GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY g)) AS version FROM g""")
def content_version(spark, d):
    return E.content_version(table(spark, d, "documents"), ["doc_id"], F.col("text"))


@query("path_rollup", "SELECT p_brand || '/' || p_type AS folder, count(*) AS modules, sum(p_size)::BIGINT AS functions, sum(p_size % 5)::BIGINT AS classes FROM part GROUP BY 1")
def path_rollup(spark, d):
    m = view(spark, d, "SELECT concat(p_brand, '/', p_type, '/', p_name, '/', p_partkey, '.py') AS path, p_size AS functions, p_size % 5 AS classes FROM part")
    return E.rollup_paths(m, "path", 2)


@query("domain_directory", "SELECT p_brand, count_if(p_type = 'PROMO') AS promo, count_if(p_type = 'ECONOMY') AS economy, count(*) AS \"all\" FROM part GROUP BY ROLLUP (1)")
def domain_directory(spark, d):
    return E.directory(table(spark, d, "part"), "p_brand", "p_type", ["PROMO", "ECONOMY"])


@query("top_imports", "SELECT word, n FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS k FROM (SELECT unnest(string_split(p_name, ' ')) AS word, count(*) AS n FROM part GROUP BY 1) WHERE word NOT IN ('red', 'blue')) WHERE k <= 10")
def top_imports(spark, d):
    """The ten most common names outside a stop list (a top-k report)."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).filter(~F.col("word").isin("red", "blue"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(10)


@query("untested_sources", "SELECT p_partkey FROM part a WHERE p_size > 20 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_type = 'PROMO')")
def untested_sources(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size > 20").join(p.filter("p_type = 'PROMO'").select("p_name"), "p_name", "left_anti").select("p_partkey")
