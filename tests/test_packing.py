"""Compression under presets, agent state, overviews, exports, analytics packs, code packs and saved state."""

import json

import pytest
from pyspark.sql import functions as F

from lorespark import code_pack, pack
from lorespark.operators import analytics, compress
from lorespark.sources import documents, state

CUSTOMER = """entity: customer
description: someone who buys
golden_source: CRM
identifier:
  name: customer_id
  type: UUID
  required: true
pii: [name, email]
retention:
  months: 36
status_machine: open -> paid
note: checked only-if(active) within ±30d of the order date
"""
ORDER = "entity: order\nidentifier:\n  name: order_id\n  type: UUID\nbelongs_to:\n  entity: customer\n  field: customer_id\nquality: reviewed daily by the owners of the ledger\n"


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pack")
    (d / "entities").mkdir()
    (d / "entities/customer.yaml").write_text(CUSTOMER)
    (d / "entities/order.yaml").write_text(ORDER)
    (d / "rules.yaml").write_text("rules:\n  no_ghosts: every order has a customer\n")
    (d / "notes.md").write_text("# Entity: CUSTOMER\n\n## Known issues\n\n> **Warning:** phones are unreliable\n")
    return pack.pack(spark, str(d), {"domain": "sales"})


def test_compress_keeps_what_must_stay_and_reports_sizes(packed):
    rows = packed.compressed().orderBy("ord").collect()
    head = {r["key"]: r["value"] for r in rows if r["node_type"] == "header"}
    assert head["DOMAIN"] == "sales" and head["SOURCE_TOKENS"] == f"~{packed.source_words}" and head["RATIO"].startswith("~")
    keys = [(r["section"], r["key"]) for r in rows if r["node_type"] == "pair"]
    assert ("ENTITY-CUSTOMER", "IDENTIFIER") in keys and ("RULES", "NO-GHOSTS") in keys and any(s == "ENTITY-ORDER" for s, _ in keys)
    assert [r["ord"] for r in rows] == sorted({r["ord"] for r in rows})
    assert any(r["section"] == "WARNINGS" and "unreliable" in r["value"] for r in rows)


def test_presets(packed, spark):
    with pytest.raises(ValueError):
        packed.compressed("no-such")
    f = spark.createDataFrame([("IDENTIFIER", "a b", 0.1), ("NOTE", "a b", 0.7), ("NOTE", "a b", 0.4), ("NOTE", "a b", 0.2), ("KEPT", "a b", 0.0)], "key string, value string, s double")
    said = lambda p: [r["x"] for r in f.select(compress.field_decision(F.col("key"), F.col("value"), F.col("s"), compress.preset(p), ("KEPT",)).alias("x")).collect()]
    assert said("aggressive") == ["include", "include", "abbreviate", "drop", "include"]
    assert said("balanced") == ["include", "include", "include", "drop", "include"] and set(said("conservative")) == {"include"}


def test_expansion_below_the_floor(packed):
    small, full = packed.compressed(), packed.compressed(floor=10_000)
    text = lambda n: " ".join(r["value"] for r in n.filter("node_type = 'line'").collect())
    assert "someone who buys" in text(full) and "someone who buys" not in text(small)


def test_overview_and_indexes(packed):
    nodes = packed.nodes
    o = {}
    for r in documents.overview(nodes).orderBy("part", "ord").collect():
        o.setdefault(r["part"], []).append(r["text"])
    assert any(t.startswith("CUSTOMER(bridge)") or t.startswith("CUSTOMER(hub)") for t in o["ENTITIES"]) and any(t.startswith("ORDER(bridge)") and "id:" in t for t in o["ENTITIES"])
    assert any(t.startswith("GRAPH:2-entities,") for t in o["TOPOLOGY"]) and "BRIDGES:CUSTOMER+ORDER" in o["TOPOLOGY"]
    assert any(t.startswith("CUSTOMER:RETENTION→") for t in o["PATTERNS"]) and any(t.startswith("GUARD:CUSTOMER:NOTE→only-if(active)") for t in o["PATTERNS"]) and any(t == "WINDOW:CUSTOMER:NOTE→±30days" for t in o["PATTERNS"])
    assert any(t.startswith("ID-PATTERN:2/2→") for t in o["PATTERNS"]) and o["CONSTRAINTS"][0].startswith("CUSTOMER:PII→")
    i = {(r["index"], r["key"]): r["value"] for r in documents.indexes(nodes).collect()}
    assert i["ENTITY-INDEX", "ORDER"].startswith("±ENTITY-ORDER ~") and "keys:[" in i["SECTION-INDEX", "ENTITY-CUSTOMER"] and "pii" in i["KEYWORD-INDEX", "ENTITY-CUSTOMER"].split(",")
    prompt = documents.system_prompt(nodes).first()["text"].split("\n")
    assert len(prompt) == 3 and prompt[1].startswith("- ENTITY-")


def test_json_keeps_the_tree(spark):
    text = "§PACK v1.0 L2\nDOMAIN:sales\n\n±ENTITY-A (x)\nK:v\n  ±SUB\n  J:w\n  plain\n±ENTITY-B\n"
    n = documents.nodes(spark.createDataFrame([("d", text)], "doc string, text string"))
    j = json.loads(documents.to_json(n).first()["json"])
    assert j["header"]["fields"] == {"DOMAIN": "sales"} and [s["name"] for s in j["body"]] == ["ENTITY-A", "ENTITY-B"]
    a = j["body"][0]["children"]
    assert a[0] == {"type": "kv", "key": "K", "value": "v"} and a[1]["name"] == "SUB" and a[1]["children"][0]["key"] == "J"


STEPS = [(0, {"entities": [{"name": "Order", "status": "open", "total": 5}]}), (1, {"tool": "search", "result": {"hits": 3}}), (2, {"entities": [{"name": "order", "status": "paid"}], "decision": "ship it"}), (3, {})]


def steps(spark, rows=STEPS):
    return spark.createDataFrame([(i, json.dumps(s)) for i, s in rows], "step int, json string")


def test_agent_state(spark):
    nodes, m = compress.compress_steps(steps(spark))
    pairs = {(r["section"], r["key"]): r["value"] for r in nodes.filter("node_type = 'pair'").collect()}
    assert pairs["ENTITY-ORDER", "STATUS"] == "paid" and pairs["ENTITY-ORDER", "TOTAL"] == "5" and pairs["ENTITY-TOOL-SEARCH", "HITS"] == "3" and pairs["RULES", "DECISION-2"] == "ship it"
    assert (m["entities_merged"], m["conflicts"], m["steps"]) == (1, 1, 4) and m["tokens_raw"] > 0 and m["ratio"] > 0


def test_agent_session_evicts_beyond_its_budget(spark, tmp_path):
    rows = [(i, {"entities": [{"name": f"E{i}", "about": "one two three", "uses": "@ENTITY-E0"}]}) for i in range(6)]
    (tmp_path / "in").mkdir()
    for i in range(0, 6, 3):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"step": k, "json": json.dumps(s)}) for k, s in rows[i : i + 3]))
    session = compress.Session(budget=20)
    q = spark.readStream.schema("step int, json string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).writeStream.foreachBatch(session.update).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    left = {r["entity"] for r in session.facts.filter("kind = 'entity'").collect()}
    assert "E0" in left and len(left) < 6
    oldest = compress.Session(budget=20, strategy="oldest")
    oldest.update(steps(spark, rows))
    assert "E5" in {r["entity"] for r in oldest.facts.collect()} and "E0" not in {r["entity"] for r in oldest.facts.filter("kind = 'entity'").collect()}
    assert session.snapshot().filter("node_type = 'section'").count() >= len(left)


PACK = """description: shops
fingerprints:
  - id: sku
    patterns: [p1, p2]
ontology:
  metrics:
    - {id: basket_size, definition: items a sale, formula: a / b}
  dimensions:
    - {id: store, hierarchy: [city, shop]}
  synonyms:
    - {term: basket, canonical: retail.metrics.basket_size}
    - {term: nothing, canonical: retail.metrics.ghost}
guardrails: {pii: [email]}
vocabulary: {entities: {customer: [shopper, buyer]}}
"""


def test_analytics_packs(spark, tmp_path):
    for d in ("retail", "travel"):
        (tmp_path / d / "v1").mkdir(parents=True)
        (tmp_path / d / "v1/pack.yaml").write_text(PACK)
    f = analytics.read_packs(spark, str(tmp_path))
    got = {(r["kind"], r["entity"], r["key"], r["value"]) for r in f.collect()}
    assert {("entity", "METRIC-RETAIL-BASKET-SIZE", "description", "items a sale"), ("field", "DOMAIN-RETAIL", "FP-SKU", "p1+p2"), ("field", "DIM-TRAVEL-STORE", "HIERARCHY", "city+shop"), ("alias", "DOMAIN-RETAIL", "customer", "shopper"), ("field", "DOMAIN-RETAIL", "PII", "email")} <= got
    s = f.filter("kind = 'synonym'").select(F.col("key").alias("term"), F.col("value").alias("canonical"))
    assert [tuple(r) for r in analytics.synonym_aliases(s, f.filter("kind = 'entity'")).collect()] == [("METRIC-RETAIL-BASKET-SIZE", "basket")]
    once = analytics.fingerprint_dedup(f).filter("key = 'FP-SKU'").collect()
    assert len(once) == 1 and once[0]["domain"] == "retail" and once[0]["others"].endswith("travel/v1/pack.yaml")


def test_commit_conventions_and_test_setup(spark):
    c = spark.createDataFrame([(i, "abcdef1 feat(x): y" if i % 3 else "Merge it") for i in range(40)], "ord int, line string")
    verdict, top = analytics.commit_conventions(c)
    assert tuple(verdict.first()) == (30, 20, True) and tuple(top.first()) == ("feat", 20)
    files = spark.createDataFrame([("a/pyproject.toml", "[tool.pytest]\naddopts = '--cov-fail-under=80'"), ("w/vitest.config.ts", ""), ("x.py", "")], "path string, text string")
    assert {tuple(r)[1:] for r in analytics.test_setup(files).collect()} == {("pytest", 80), ("vitest", None)}


def test_code_pack(spark):
    files = [(".gitignore", "# no\nskip/\n"), ("skip/z.py", "def z(): pass"), ("src/a.py", "def core(x):\n    return x\n\ndef user():\n    return core(1)\n"), ("tests/test_a.py", "def test_core():\n    core(2)\n"), ("web/c.tsx", "export function Card() { return <b/> }")]
    p = code_pack.pack_codebase(spark.createDataFrame(files, "path string, text string"))
    assert p.list_symbols("src/a.py").first()["qname"] == "core" and p.list_symbols("nope.py")["error"]["code"] == "unknown_module" and p.list_symbols("src/a.py", 0)["error"]["code"] == "invalid_input"
    assert [r["body"] for r in p.hydrate_symbol("core").collect()] == ["def core(x):\n    return x"]
    assert {r["qname"] for r in p.hydrate_symbol("core", 1).collect()} == {"core", "user", "test_core"}
    assert p.hydrate_symbol("ghost")["error"]["code"] == "unknown_symbol" and p.hydrate_symbol("core", 2)["error"]["code"] == "invalid_input"
    assert p.raw_file("src/a.py")["bytes"] == len(files[2][1]) and p.raw_file("../x")["error"]["code"] == "path_outside_root"
    assert p.raw_file("skip/z.py")["error"]["code"] == "ignored_path" and p.raw_file("no.py")["error"]["code"] == "unknown_module"
    assert p.search("core").first()["qname"] == "core"


def test_saved_state_and_the_rest(spark, tmp_path):
    d, schema = str(tmp_path / "state"), "name string, confidence double"
    assert state.load_state(spark, d, schema).count() == 0
    for x in (0.1, 0.2):
        state.save_state(spark.createDataFrame([("a", x)], schema), d)
        assert state.load_state(spark, d, schema).first()["confidence"] == x
    (tmp_path / "q.yaml").write_text("questions:\n  - {id: q1, question: why, expected: so, entities: [A]}\n")
    q = state.read_questions(spark, str(tmp_path / "q.yaml"))
    assert tuple(q.first()) == ("q1", "why", "so", "", ["A"])
    state.save_results(q, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    a, b = (spark.createDataFrame(r, "path string, text string") for r in ([("x.md", "1"), ("golden/y.md", "old")], [("y.md", "new"), ("conf.yaml", "c")]))
    assert {tuple(r) for r in state.overlay(a, b, "golden", "conf.yaml").collect()} == {("x.md", "1"), ("golden/y.md", "new")}
    assert [tuple(r) for r in state.retry_schedule(spark, 4, 1.0, 3.0).collect()] == [(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.0, 6.0), (4, 3.0, 9.0)]
    e = spark.createDataFrame([("s", 1.0, ["A", "B"])], "session_id string, ts double, sections array<string>")
    assert {tuple(r) for r in state.observed(e, spark.createDataFrame([("s", "warn")], "session_id string, advice string")).collect()} == {("A", False, 1.0), ("B", False, 1.0)}
    assert list(state.generated(500, 1)) == list(state.generated(500, 1)) and sum(len(t.split()) for _, t in state.generated(500, 1)) >= 500
