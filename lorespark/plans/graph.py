"""Graph queries: part-supplier co-supply and nation-region references stand in for the entity and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.catalog import query
from lorespark.operators import graph as G
from lorespark.plans.base import table, view

#: Who supplied what after whom: consecutive line items of an order link their suppliers.
LINKS = "SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey"


def _links(spark, d):
    return view(spark, d, LINKS)


@query("entity_graph", """
WITH r AS (SELECT 'ENTITY-C-' || o_custkey AS a, 'ENTITY-P-' || upper(substring(o_orderpriority, 1, 1)) AS b FROM orders) SELECT DISTINCT a AS src, b AS dst FROM r UNION SELECT b, a FROM r""")
def entity_graph(spark, d):
    f = view(spark, d, "SELECT concat('ENTITY-C-', o_custkey) AS entity, CASE WHEN o_orderkey % 2 = 0 THEN 'BELONGS-TO' ELSE 'NOTE' END AS key, CASE WHEN o_orderkey % 2 = 0 THEN concat('p-', lower(substring(o_orderpriority, 1, 1)), '(id)') ELSE concat('see @ENTITY-P-', substring(o_orderpriority, 1, 1), '.') END AS value FROM orders")
    return G.reference_edges(f)


@query("neighbours", f"""
WITH l AS ({LINKS}), u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l) SELECT src, array_to_string(list_slice(list(dst ORDER BY dst), 1, 6), ',') AS neighbours FROM u GROUP BY 1""")
def neighbours(spark, d):
    return G.neighbours(G.both_ways(_links(spark, d)), 6).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query("graph_export", f"""
WITH l AS ({LINKS}), u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l) SELECT count(DISTINCT src) AS node_count, count(*) // 2 AS edge_count, max(k) AS max_degree FROM u JOIN (SELECT src AS s, count(*) AS k FROM u GROUP BY 1) ON s = src""")
def graph_export(spark, d):
    g = G.both_ways(_links(spark, d)).groupBy("src").agg(F.count("*").alias("k"))
    return g.agg(F.count("*").alias("node_count"), F.expr("sum(k) div 2").alias("edge_count"), F.max("k").alias("max_degree"))


BFS_EDGES = "SELECT c_custkey AS src, c_custkey * 2 AS dst FROM customer UNION SELECT c_custkey * 2, c_custkey FROM customer UNION SELECT c_custkey, c_custkey * 3 FROM customer UNION SELECT c_custkey * 3, c_custkey FROM customer"


@query("bfs", f"""
WITH RECURSIVE e AS ({BFS_EDGES}), w AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS depth FROM supplier UNION SELECT start, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3)
SELECT start, node, min(depth) AS depth FROM w WHERE node <> start GROUP BY 1, 2""")
def bfs(spark, d):
    return G.bfs(view(spark, d, BFS_EDGES), table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), 3)


@query("shortest_path", f"""
WITH RECURSIVE n AS ({BFS_EDGES}), e AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM n), q AS (SELECT CAST(s_suppkey AS VARCHAR) AS src, CAST(s_suppkey * 12 AS VARCHAR) AS dst FROM supplier),
w AS (SELECT src AS s, dst AS t, src AS node, [src] AS path FROM q UNION ALL SELECT s, t, e.dst, list_append(path, e.dst) FROM w JOIN e ON e.src = node WHERE len(path) < 5 AND node <> t AND NOT list_contains(path, e.dst)),
h AS (SELECT s, t, path FROM w WHERE node = t), m AS (SELECT s, t, min(len(path)) AS n FROM h GROUP BY 1, 2)
SELECT q.src, q.dst, coalesce(array_to_string(min(path), '>'), '') AS path FROM q LEFT JOIN (SELECT h.* FROM h JOIN m ON h.s = m.s AND h.t = m.t AND len(path) = n) b ON b.s = q.src AND b.t = q.dst GROUP BY 1, 2""")
def shortest_path(spark, d):
    e = view(spark, d, f"SELECT CAST(src AS STRING) AS src, CAST(dst AS STRING) AS dst FROM ({BFS_EDGES})")
    q = view(spark, d, "SELECT CAST(s_suppkey AS STRING) AS src, CAST(s_suppkey * 12 AS STRING) AS dst FROM supplier")
    return G.shortest_paths(e, q, 4).withColumn("path", F.array_join("path", ">"))


def _pagerank_sql(rounds: int, gives: str) -> str:
    """The rounds unrolled into tables."""
    ctes = [
        f"l AS MATERIALIZED ({LINKS})", f"nd AS MATERIALIZED (SELECT s_suppkey AS node, (SELECT count(*) FROM supplier)::DOUBLE AS n, s_suppkey NOT IN (SELECT src FROM l) AS sink, {gives}::DOUBLE AS g FROM supplier)",
        "w AS MATERIALIZED (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM l)", "r0 AS MATERIALIZED (SELECT node, sink, g, 1 / n AS score FROM nd)",
    ]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT node, sink, g, (0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score * g) FILTER (WHERE sink), 0) FROM r{k}) / n)) / (0.15 + 0.85 * (SELECT sum(score * g) FROM r{k})) AS score FROM nd LEFT JOIN (SELECT dst, sum(share * score * g) AS got FROM w JOIN r{k} ON src = node GROUP BY 1) ON dst = node)")
    return f"WITH {', '.join(ctes)} SELECT node, round(score, 9) AS score FROM r{rounds}"


@query("pagerank", _pagerank_sql(30, "1"))
def pagerank(spark, d):
    return G.pagerank(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), _links(spark, d)).withColumn("score", F.round("score", 9))


@query("pagerank_boosted", _pagerank_sql(30, "CASE WHEN s_acctbal < 0 THEN 3 ELSE 1 END"))
def pagerank_boosted(spark, d):
    s = table(spark, d, "supplier")
    return G.pagerank(s.select(F.col("s_suppkey").alias("node")), _links(spark, d), boosted=s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))).withColumn("score", F.round("score", 9))


@query("topology", f"""
WITH l AS ({LINKS}), i AS (SELECT dst AS node, count(*) AS inbound FROM l GROUP BY 1), o AS (SELECT src AS node, count(*) AS outbound FROM l GROUP BY 1)
SELECT s_suppkey AS node, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, CASE WHEN coalesce(inbound, 0) >= 3 THEN 'hub' WHEN coalesce(inbound, 0) = 0 THEN 'leaf' ELSE 'bridge' END AS role FROM supplier LEFT JOIN i ON i.node = s_suppkey LEFT JOIN o ON o.node = s_suppkey""")
def topology(spark, d):
    return G.topology(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), _links(spark, d))


@query("callee_resolution", """
WITH n AS (SELECT p_brand || '.' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_' || p_partkey END AS q FROM part), nodes AS (SELECT DISTINCT q, regexp_extract(q, '([^.]+)$', 1) AS local FROM n),
one AS (SELECT local, min(q) AS q FROM nodes GROUP BY 1 HAVING count(*) = 1),
c AS (SELECT p_partkey AS caller, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'self.' ELSE p_brand || '.' END || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '_' || p_partkey END AS callee FROM part)
SELECT caller, callee, coalesce(x.q, a.q, b.q) AS resolved FROM c LEFT JOIN nodes x ON x.q = callee LEFT JOIN one a ON a.local = callee LEFT JOIN one b ON b.local = regexp_extract(callee, '([^.]+)$', 1)""")
def callee_resolution(spark, d):
    nodes = view(spark, d, "SELECT DISTINCT concat(p_brand, '.', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('_', p_partkey) END) AS qname FROM part")
    calls = view(spark, d, "SELECT p_partkey AS caller, concat(CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'self.' ELSE concat(p_brand, '.') END, replace(p_name, ' ', '_'), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('_', p_partkey) END) AS callee FROM part")
    return G.resolve_callees(calls, nodes).select("caller", "callee", "resolved")


@query("depth_one", f"""
WITH l AS ({LINKS}), n AS (SELECT s_suppkey AS node, s_acctbal AS score, s_suppkey % 7 AS size FROM supplier), c AS (SELECT src AS start, dst AS node FROM l UNION SELECT dst, src FROM l),
r AS (SELECT start, node, sum(size) OVER w AS used, row_number() OVER w AS place FROM c JOIN n USING (node) WHERE size > 0 WINDOW w AS (PARTITION BY start ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING))
SELECT start, node, CAST(place AS INTEGER) AS place FROM r WHERE used <= 12""")
def depth_one(spark, d):
    n = view(spark, d, "SELECT s_suppkey AS node, s_acctbal AS score, s_suppkey % 7 AS size FROM supplier")
    return G.depth_one(n.select("node"), _links(spark, d), n, 12)
