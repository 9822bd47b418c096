"""Graph queries against brute force over a fixture, apart from their SQL, which reads the same edge expression."""

import random
from collections import defaultdict

import pytest

from lorespark import catalog
from lorespark.plans import graph


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, suppliers, line items): 9 suppliers, orders of every key, some with gaps between line numbers."""
    d, r = str(tmp_path_factory.mktemp("graph")), random.Random(7)
    suppliers = [(k, float(r.randint(-5, 40))) for k in range(1, 10)]
    items = [(o, n, r.choice([1, 2, 3, 4, 5, 6, 7, 8])) for o in range(1, 14) for n in range(1, r.randint(2, 4)) if r.random() < 0.9]
    spark.createDataFrame(suppliers, "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber long, l_suppkey long").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d, suppliers, items


def brute_links(items):
    at = defaultdict(set)
    for o, n, s in items:
        at[o, n].add(s)
    return {(a, b) for (o, n), x in at.items() for a in x for b in at.get((o, n + 1), ()) if a != b}


def around(links):
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
        out[b].add(a)
    return out


def ran(spark, d, name):
    return {tuple(r) for r in catalog.queries()[name](spark, d).collect()}


def test_links_are_of_all_orders(spark, tables):
    d, _, items = tables
    assert {tuple(r) for r in graph._links(spark, d).collect()} == brute_links(items) != set()


def test_neighbours_and_export_of_all_orders(spark, tables):
    d, _, items = tables
    near = around(brute_links(items))
    assert ran(spark, d, "neighbours") == {(k, ",".join(map(str, sorted(x)[:6]))) for k, x in near.items()}
    assert ran(spark, d, "graph_export") == {(len(near), sum(map(len, near.values())) // 2, max(map(len, near.values())))}


def test_topology_of_all_orders(spark, tables):
    d, suppliers, items = tables
    want = set()
    for k, _ in suppliers:
        i, o = (sum(e[c] == k for e in brute_links(items)) for c in (1, 0))
        want.add((k, i, o, "hub" if i >= 3 else "leaf" if not i else "bridge"))
    assert ran(spark, d, "topology") == want


def test_depth_one_of_all_orders(spark, tables):
    d, suppliers, items = tables
    score, want = dict(suppliers), set()
    for start, x in around(brute_links(items)).items():
        used = 0
        for place, node in enumerate(sorted((k for k in x if k % 7), key=lambda k: (-score[k], k)), 1):
            used += node % 7
            if used > 12:
                break
            want.add((start, node, place))
    assert ran(spark, d, "depth_one") == want


def test_pagerank_runs_thirty_rounds(spark, tables):
    d, suppliers, items = tables
    links, nodes = brute_links(items), [k for k, _ in suppliers]
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        lost = sum(score[k] for k in nodes if not out[k])
        nxt = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for a, x in out.items():
            for b in x:
                nxt[b] += 0.85 * score[a] / len(x)
        score = nxt
    got = dict(ran(spark, d, "pagerank"))
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 2e-9 for k in nodes)
