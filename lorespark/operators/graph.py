"""Graph operators over edge tables. Loops have a bounded number of rounds and cut their lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.cuts import cut

DAMPING, ROUNDS = 0.85, 30


def reference_edges(fields: DataFrame) -> DataFrame:
    """(src, dst), both ways and distinct, from (entity, key, value): references in values, targets in relationship keys."""
    refs = F.regexp_extract_all(F.col("value"), F.lit("@(ENTITY-[A-Za-z0-9_][A-Za-z0-9_-]*)"), 1)
    named = F.transform(F.regexp_extract_all(F.col("value"), F.lit("(?:^|\\+)([A-Za-z0-9_-]+)\\("), 1), lambda t: F.concat(F.lit("ENTITY-"), F.upper(t)))
    rel = F.upper(F.col("key")).rlike("^(BELONGS-TO|HAS-MANY|HAS-ONE|DEPENDS-ON|REFERENCES)$")
    e = fields.select(F.col("entity").alias("src"), F.explode(F.array_distinct(F.when(rel, F.concat(refs, named)).otherwise(refs))).alias("dst")).filter("src <> dst")
    return both_ways(e)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, neighbours): sorted, the first ``most`` of them."""
    g = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return g if most is None else g.withColumn("neighbours", F.slice("neighbours", 1, most))


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): for every start the nodes within ``depth`` steps, without itself; many starts in one job."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        step = front.select("start", F.col("node").alias("src")).join(edges, "src").select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(src, dst, path): the lexicographically least of the shortest paths, empty where none has ``most`` steps or fewer.

    A round keeps one least path for each pair and node, so it grows with nodes and not with paths.
    """
    front = pairs.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.col("src").alias("node"), F.array("src").alias("path")).distinct()
    found, seen = front.filter("s = t"), front.select("s", "t", "node")
    front = front.filter("s <> t")
    for _ in range(most):
        step = front.join(edges, F.col("node") == F.col("src")).select("s", "t", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = cut(step.groupBy("s", "t", "node").agg(F.min("path").alias("path")).join(seen, ["s", "t", "node"], "left_anti"), "paths")
        hit = step.filter("node = t")
        found = found.unionByName(hit)
        front = cut(step.join(hit.select("s", "t"), ["s", "t"], "left_anti"), "paths")
        seen = seen.unionByName(front.select("s", "t", "node"))
    best = found.select(F.col("s").alias("src"), F.col("t").alias("dst"), "path")
    return pairs.select("src", "dst").distinct().join(best, ["src", "dst"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, boosted: DataFrame | None = None, boost: float = 3.0) -> DataFrame:
    """(node, score): damping 0.85, the mass of nodes without edges spread evenly, scores adding up to 1.

    Repeated edges count as often as they occur. ``boosted`` nodes (tests, for one) give away ``boost`` times their mass; each
    round is divided by its total again, which is known from what was given away. That is a scalar of a small aggregate.
    """
    known = nodes.select("node").distinct()
    w = edges.select("src", "dst").join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    w = w.groupBy("src", "dst").agg(F.count("*").alias("w"))
    w = cut(w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"), "links")
    n = known.count()
    if not n:
        return known.withColumn("score", F.lit(0.0))
    sinks = known.join(w.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("sink", F.lit(True))
    more = (known.limit(0) if boosted is None else boosted.select("node").distinct()).withColumn("gives", F.lit(float(boost)))
    rank = known.join(sinks, "node", "left").join(more, "node", "left")
    rank = cut(rank.select("node", F.coalesce("sink", F.lit(False)).alias("sink"), F.coalesce("gives", F.lit(1.0)).alias("gives"), F.lit(1.0 / n).alias("score")), "rank")
    for _ in range(rounds):
        given = F.col("gives") * F.col("score")
        total = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), given)), F.lit(0.0)).alias("lost"), F.sum(given).alias("all"))
        got = w.join(rank.select(F.col("node").alias("src"), given.alias("given")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("given")).alias("got"))
        nxt = rank.drop("score").join(got, "node", "left").crossJoin(F.broadcast(total))  # one row
        raw = F.lit((1 - DAMPING) / n) + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        rank = cut(nxt.select("node", "sink", "gives", (raw / (F.lit(1 - DAMPING) + DAMPING * F.col("all"))).alias("score")), "rank")  # each round reads it three times
    return rank.select("node", "score")


def topology(nodes: DataFrame, edges: DataFrame, hub: int = 3) -> DataFrame:
    """(node, inbound, outbound, role): hub with ``hub`` inbound edges or more, leaf without one, else bridge."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inbound"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outbound"))
    t = nodes.join(i, "node", "left").join(o, "node", "left").na.fill(0, ["inbound", "outbound"])
    return t.withColumn("role", F.when(F.col("inbound") >= hub, "hub").when(F.col("inbound") == 0, "leaf").otherwise("bridge"))


def resolve_callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``resolved`` to (caller, callee): the node of that name, else the only node with it as local name, else with its last dotted part."""
    local = F.regexp_extract("qname", "([^.:/]+)$", 1)
    one = nodes.withColumn("local", local).groupBy("local").agg(F.min("qname").alias("only"), F.count("*").alias("n")).filter("n = 1").drop("n")
    e = edges.withColumn("tail", F.regexp_extract("callee", "([^.]+)$", 1))
    e = e.join(nodes.select(F.col("qname").alias("exact")).distinct(), F.col("callee") == F.col("exact"), "left")
    e = e.join(one.toDF("l1", "by_local"), F.col("callee") == F.col("l1"), "left").join(one.toDF("l2", "by_tail"), F.col("tail") == F.col("l2"), "left")
    return e.withColumn("resolved", F.coalesce("exact", "by_local", "by_tail")).drop("tail", "exact", "l1", "by_local", "l2", "by_tail")


def depth_one(starts: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(start, node, place): callers and callees with a body, by centrality, as long as their sizes fit; nodes have (node, score, size)."""
    near = starts.select(F.col("node").alias("start"))
    out = near.join(edges, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"))
    in_ = near.join(edges, F.col("start") == F.col("dst")).select("start", F.col("src").alias("node"))
    c = out.unionByName(in_).distinct().filter("start <> node").join(nodes.filter("size > 0"), "node")
    w = Window.partitionBy("start").orderBy(F.col("score").desc(), "node")
    c = c.withColumn("used", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return c.filter(F.col("used") <= budget).select("start", "node", "place")
