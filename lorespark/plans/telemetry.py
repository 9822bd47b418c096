"""Queries over the event log: a session is a user, a section an event type, the match count the number in props."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.operators import telemetry as M
from lorespark.plans.base import table, view

LOG = """SELECT CAST(user_id AS STRING) AS session_id, array(event_type) AS sections_requested, CAST(get_json_object(props, '$.k') AS INT) % 7 AS sections_matched, CAST(round(value) AS INT) AS tokens, event_type = 'error' AS rehydrated, value AS latency_ms FROM events"""
K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("telemetry_summary", f"""
SELECT count(*) AS total, count(DISTINCT user_id) AS sessions, round(avg(CAST(round(value) AS INT)), 6) AS avg_tokens, round(avg((event_type = 'error')::INT), 6) AS rehydration_rate, round(avg(value), 6) AS avg_latency_ms, round(avg(({K} % 7 = 0)::INT), 6) AS zero_match_rate FROM events""")
def telemetry_summary(spark, d):
    return M.summary(view(spark, d, LOG))


@query("top_sections", "SELECT event_type AS section, count(*) AS n FROM events GROUP BY 1")
def top_sections(spark, d):
    return M.top_sections(view(spark, d, LOG))


@query("event_rates", """
SELECT count(*) AS total, round(count_if(event_type = 'error')::DOUBLE / nullif(count_if(event_type = 'view'), 0), 6) AS raw_rate, round(count_if(event_type = 'login')::DOUBLE / nullif(count_if(event_type = 'view'), 0), 6) AS unknown_rate,
 round(count_if(event_type = 'click')::DOUBLE / nullif(count_if(event_type = 'purchase'), 0), 6) AS reformulated_rate FROM events""")
def event_rates(spark, d):
    return M.rates(table(spark, d, "events"), "view", "error", "purchase", "click", "login")


BASKETS = """SELECT concat_ws('-', user_id, date_format(ts, 'yyyyMMddHH')) AS event, collect_list(event_type) AS sections_requested, max(sha2(props, 256)) AS question_hash FROM events GROUP BY 1"""
PAIRS = f"""
b AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS event, event_type, sha256(props) AS q FROM events), qs AS (SELECT event, max(q) AS q FROM b GROUP BY 1), s AS (SELECT DISTINCT event, event_type AS t FROM b),
p AS (SELECT x.t AS a, y.t AS b, count(*) AS n, count(DISTINCT nullif(q, '')) AS questions FROM s x JOIN s y ON x.event = y.event AND x.t < y.t JOIN qs ON qs.event = x.event GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("cooccurrence", f"WITH {PAIRS} SELECT * FROM p")
def cooccurrence(spark, d):
    return M.co_occurrences(view(spark, d, BASKETS))


@query("pattern_entities", f"""
WITH {PAIRS}, f AS (SELECT *, unnest(['pattern', 'section_a', 'section_b', 'observed_in_questions']) AS key FROM p)
SELECT 'PATTERN-' || a || '-AND-' || b AS name, least(1.0::DOUBLE, n / 20.0) AS confidence, n AS observations, key, CASE key WHEN 'pattern' THEN 'co-retrieved' WHEN 'section_a' THEN a WHEN 'section_b' THEN b ELSE CAST(questions AS VARCHAR) END AS value FROM f""")
def pattern_entities(spark, d):
    return M.pattern_fields(M.co_occurrences(view(spark, d, BASKETS)))


@query("gaps", """
SELECT sha256(props) AS question_hash, count(*) AS n, min(CAST(ts AS VARCHAR)[1:19]) AS first_seen, max(CAST(ts AS VARCHAR)[1:19]) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3""")
def gaps(spark, d):
    return M.gaps(view(spark, d, "SELECT sha2(props, 256) AS question_hash, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS sections_matched FROM events"))


FOLD = """
f AS (SELECT user_id, list_reduce(list_concat([0.0::DOUBLE], list(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY ts, event_id)), lambda c, s: CASE WHEN s > 0 THEN c + (1 - c) * 0.1 ELSE c * 0.5 END) AS confidence,
 count_if(event_type <> 'error') AS confirmations, count_if(event_type = 'error') AS contradictions, max(ts) AS last_observed FROM events GROUP BY 1)"""


def _state(spark, d):
    return M.confidence(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")


@query("confidence_fold", f"WITH {FOLD} SELECT user_id, round(confidence, 9) AS confidence, confirmations, contradictions FROM f")
def confidence_fold(spark, d):
    return _state(spark, d).select("user_id", F.round("confidence", 9).alias("confidence"), "confirmations", "contradictions")


@query("confidence_decayed", f"WITH {FOLD}, g AS (SELECT user_id, confidence * pow(0.95, greatest(0, (epoch_us(TIMESTAMP '2024-02-10') - epoch_us(last_observed)) / 86400000000.0)) AS c FROM f) SELECT user_id, round(c, 9) AS current FROM g WHERE c >= 0.2")
def confidence_decayed(spark, d):
    return M.decayed(_state(spark, d), F.lit("2024-02-10").cast("timestamp"), 0.2).select("user_id", F.round("current", 9).alias("current"))


@query("confidence_stamped", """
WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'ENTITY-' ELSE '' END || s_name AS name, round(s_acctbal / 10000, 4) AS c FROM supplier)
SELECT s_name AS name, CASE WHEN s_acctbal < 0 THEN 'rules' ELSE 'inferred' END AS layer, CASE WHEN s_acctbal < 0 THEN 1.0 ELSE coalesce(a.c, b.c, 1.0) END AS stamped FROM supplier LEFT JOIN s a ON a.name = 'ENTITY-' || s_name LEFT JOIN s b ON b.name = s_name""")
def confidence_stamped(spark, d):
    state = view(spark, d, "SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'ENTITY-' ELSE '' END, s_name) AS name, round(s_acctbal / 10000, 4) AS confidence FROM supplier")
    return M.stamped(view(spark, d, "SELECT s_name AS name, CASE WHEN s_acctbal < 0 THEN 'rules' ELSE 'inferred' END AS layer, CAST(1 AS DOUBLE) AS confidence FROM supplier"), state).select("name", "layer", "stamped")


@query("fact_ladder", """
WITH e AS (SELECT c_nationkey AS n, o_custkey AS fact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_orderstatus AS st, o_orderpriority AS expert FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT fact, k, expert, CASE WHEN k = 1 THEN 'add' WHEN st = 'F' THEN 'challenge' ELSE 'confirm' END AS act, first_value(expert) OVER (PARTITION BY fact ORDER BY k) AS owner FROM e),
v AS (SELECT *, act <> 'add' AND expert = owner AS own, CASE WHEN act = 'confirm' AND expert <> owner THEN 1 ELSE 0 END AS conf FROM a),
c AS (SELECT *, sum(conf) OVER (PARTITION BY fact ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
s AS (SELECT *, CASE WHEN act = 'add' THEN 2.0 WHEN own THEN 0.0 WHEN act = 'confirm' AND coalesce(before, 0) = 0 THEN 1.0 WHEN act = 'challenge' THEN -1.0 ELSE 0.0 END AS op FROM c)
SELECT fact, any_value(owner) AS owner, round(list_reduce(list_concat([0.0::DOUBLE], list(op::DOUBLE ORDER BY k)), lambda x, o: CASE o WHEN 2 THEN 0.7 WHEN 1 THEN greatest(x, 0.95) WHEN -1 THEN x * 0.5 ELSE x END), 9) AS confidence,
 CAST(sum(conf) AS INTEGER) AS confirms, CAST(count_if(act = 'challenge' AND NOT own) AS INTEGER) AS dissents, CAST(count_if(own) AS INTEGER) AS invalid FROM s GROUP BY fact""")
def fact_ladder(spark, d):
    a = view(spark, d, "SELECT o_custkey AS fact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord, o_orderstatus AS st, o_orderpriority AS expert FROM orders JOIN customer ON o_custkey = c_custkey")
    a = a.withColumn("act", F.when(F.col("ord") == 1, "add").when(F.col("st") == "F", "challenge").otherwise("confirm"))
    return M.fact_ladder(a).withColumn("confidence", F.round("confidence", 9))


@query("reformulated_search", """
SELECT event_id, CAST(n AS INTEGER) AS cluster_size FROM (SELECT a.event_id, count(DISTINCT b.props) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND epoch(date_trunc('second', b.ts)) BETWEEN epoch(date_trunc('second', a.ts)) - 86400 AND epoch(date_trunc('second', a.ts)) GROUP BY 1) WHERE n >= 2""")
def reformulated_search(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("search_key"), F.col("props").alias("query_hash"))
    return M.reformulated(e, ["user_id"], 86400).select("event_id", "cluster_size")


@query("raw_after_hydrate", """
WITH n AS (SELECT *, count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seq FROM events),
j AS (SELECT a.event_id, a.seq - max(b.seq + 1) + 1 AS elapsed FROM n a JOIN n b ON a.user_id = b.user_id AND b.event_type = 'view' AND CAST(json_extract_string(a.props, '$.k') AS INT) % 10 = CAST(json_extract_string(b.props, '$.k') AS INT) % 10 AND (b.ts, b.event_id) < (a.ts, a.event_id) WHERE a.event_type = 'click' GROUP BY a.event_id, a.seq)
SELECT event_id, elapsed FROM j WHERE elapsed <= 5""")
def raw_after_hydrate(spark, d):
    e = table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("int") % 10)
    return M.previous_match(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view", "item").select("event_id", "elapsed")


@query("state_reset_islands", """
WITH c AS (SELECT event_id, user_id, ts, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ch FROM events)
SELECT event_id, CAST(sum(ch::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM c""")
def state_reset_islands(spark, d):
    return M.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "island")


@query("tumbling_windows", "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("started"), "event_type", "n", "total")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    return M.sessions(table(spark, d, "events"), "user_id", 6 * 3600)


@query("event_validation", f"""
SELECT event_id, concat_ws(',', CASE WHEN {K} IS NULL THEN 'k missing' END, CASE WHEN event_type = 'purchase' AND value < 10 THEN 'value too small' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'error', 'login', 'signup', 'logout') THEN 'unknown type' END) AS problems FROM events""")
def event_validation(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    problems = F.concat_ws(",", F.when(k.isNull(), "k missing"), F.when((t == "purchase") & (F.col("value") < 10), "value too small"), F.when(~t.isin("view", "click", "purchase", "error", "login", "signup", "logout"), "unknown type"))
    return table(spark, d, "events").select("event_id", problems.alias("problems"))
