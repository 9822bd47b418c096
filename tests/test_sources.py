"""Readers and writers on small corpora with known facts."""

import json

import pytest
from pyspark.sql import functions as F

from lorespark.sources import code, corpus, documents, events, extract, markdown, yaml_subset

CUSTOMER = """# people who buy
entity: Customer
description: "A buyer, unique per merchant"
golden_source: CRM (west)
aliases: [client, 'shopper']
identifier:
  name: customer_id
  type: UUID
  unique: true
match_rules:
  - field: email
    method: exact_match
    options: {case: true}
  - field: phone
    method: fuzzy
pii: [email, phone]
retention:
  active: indefinite
  churned:
    months: 36
    action: anonymise
status: [new, active, churned]
"""
ORDER = """entity: order
identifier: order_id
belongs_to: {entity: Customer, field: customer_id, mandatory: true}
retention: {closed: 84-months}
"""
RULES = "rules:\n  null_policy: email(never-null)\n  sizes:\n    - 1\n    - 2\n"
NOTES = """# Entity: Customer

Plain words before a key are dropped.

## Known issues
- The email is really often missing
> **Warning:** do not trust phones
> **Note:** ask support
Some prose here.

# General
- a rule of the house
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "entities").mkdir()
    (d / "entities/customer.yaml").write_text(CUSTOMER)
    (d / "entities/order.yml").write_text(ORDER)
    (d / "rules.yaml").write_text(RULES)
    (d / "notes.md").write_text(NOTES)
    (d / "fields.csv").write_text("entity,field_name,type,description,nullable,pii\nInvoice,total,DECIMAL,money due,no,no\nInvoice,mail,TEXT,,yes,yes\n")
    (d / "schema.json").write_text(json.dumps({"title": "Parcel", "properties": {"id": {"type": "string", "format": "uuid"}, "kg": {"type": "number"}}, "required": ["id"]}))
    (d / "list.json").write_text(json.dumps({"stock_items": [{"a": 1, "b": 2}, {"a": 3, "c": 4}]}))
    (d / "shop.toml").write_text("[entity.Shop]\nidentifier = 'shop_id'\n")
    (d / "bad.json").write_text("{oops")
    (d / "corpus.yaml").write_text("domain: sales\n")
    (d / "skip.txt").write_text("no")
    return str(d)


@pytest.fixture(scope="module")
def facts(spark, folder):
    return [r.asDict() for r in corpus.facts(corpus.discover(spark, folder)).collect()]


def test_discovery_filters_and_classifies(spark, folder):
    assert {(r.rel_path, r.fmt) for r in corpus.discover(spark, folder).collect()} == {("entities/customer.yaml", "yaml"), ("entities/order.yml", "yaml"), ("rules.yaml", "yaml"), ("notes.md", "md"), ("fields.csv", "csv"), ("schema.json", "json"), ("list.json", "json"), ("shop.toml", "toml"), ("bad.json", "json")}
    assert {r.rel_path for r in corpus.discover(spark, folder, include=["*.yaml", "*.yml"], exclude=["rules*"]).collect()} == {"entities/customer.yaml", "entities/order.yml"}
    assert corpus.matches_any("a/b/c.md", ["a/*.md"])


def test_config():
    c = corpus.load_config("domain: sales\nentity_aliases:\n  customer: [client]\nexclude:\n  - tmp/*\n")
    assert (c["domain"], c["entity_aliases"], c["exclude"], c["include"]) == ("sales", {"CUSTOMER": ["client"]}, ["tmp/*"], [])


def value(facts, entity, key):
    return [f["value"] for f in facts if f["kind"] == "field" and f["entity"] == entity and f["key"] == key]


def test_yaml_entity(facts):
    assert value(facts, "CUSTOMER", "IDENTIFIER") == ["customer_id(UUID,unique-per-merchant)"]
    assert value(facts, "CUSTOMER", "★GOLDEN-SOURCE") == ["CRM (west)"]
    assert value(facts, "CUSTOMER", "MATCH-RULES") == ["[email:exact-match(case),phone:fuzzy]"]
    assert value(facts, "CUSTOMER", "RETENTION") == ["active→indefinite|churned→36-months→anonymise"]
    assert value(facts, "CUSTOMER", "STATUS-MACHINE") == ["new→active→churned"]
    assert value(facts, "ORDER", "BELONGS-TO") == ["@ENTITY-CUSTOMER(customer_id,1:1,mandatory)"]
    assert {f["value"] for f in facts if f["kind"] == "alias"} == {"client", "shopper"}
    assert [(f["entity"], f["value"]) for f in facts if f["kind"] == "relationship"] == [("ORDER", "CUSTOMER")]
    assert {f["key"] for f in facts if f["kind"] == "rule" and f["fmt"] == "yaml"} == {"NULL-POLICY", "SIZES"}


def test_other_formats(facts):
    assert value(facts, "INVOICE", "TOTAL") == ["total(DECIMAL)  # money due"] and value(facts, "INVOICE", "MAIL") == ["mail(TEXT,nullable,pii)"]
    assert value(facts, "PARCEL", "ID") == ["string(uuid,required)"]
    assert value(facts, "STOCK-ITEMS", "COUNT") == ["2"] and value(facts, "STOCK-ITEMS", "SCHEMA") == ["a"]
    assert value(facts, "SHOP", "IDENTIFIER") == ["shop_id"]
    assert [f["path"] for f in facts if f["kind"] == "warning" and f["fmt"] == "json"] == ["bad.json"]


def test_markdown(facts):
    md = sorted((f["line"], f["kind"], f["entity"], f["key"], f["value"]) for f in facts if f["fmt"] == "md")
    assert md == [
        (1, "entity", "CUSTOMER", "description", ""), (6, "field", "CUSTOMER", "KNOWN-ISSUES", "email really often missing"), (7, "warning", "CUSTOMER", "KNOWN-ISSUES", "do not trust phones"),
        (8, "note", "CUSTOMER", "KNOWN-ISSUES", "ask support"), (9, "field", "CUSTOMER", "KNOWN-ISSUES", "prose here."), (12, "rule", None, "GENERAL", "rule house"),
    ]


def test_yaml_subset():
    assert yaml_subset.parse("a: 1\nb:\n- x: yes\n  y: [1, 'two, three', {k: ~}]\n- plain # c\nc: 'it''s'\nd: 1.5\nurl: http://x/y") == {"a": 1, "b": [{"x": True, "y": [1, "two, three", {"k": None}]}, "plain"], "c": "it's", "d": 1.5, "url": "http://x/y"}
    assert yaml_subset.parse("") == {}
    with pytest.raises(yaml_subset.Unsupported):
        yaml_subset.parse("a: &x 1")
    assert extract.short({"a": [1, True], "b": None}) == "a(1+yes)+b(none)"


def test_document_round_trip(spark):
    text = "§PACK v1.0 L2 SCOPE:all\nDOMAIN:sales\nAUTHOR:me\n\n±ENTITY-A (x)\nIDENTIFIER:id(UUID)\nLIST:[a,\nb]\n  ±SUB\n  K:v→w\n  1. first\n  plain line\nSRC:a.yaml#L1-L2\n±ENTITY-B\n[p, q]"
    n = documents.nodes(spark.createDataFrame([("d", text)], "doc string, text string"))
    rows = [(r.node_type, r.section, r.key, r.value) for r in n.orderBy("ord").collect()]
    assert ("pair", "ENTITY-A/SUB", "K", "v→w") in rows and ("list", "ENTITY-B", None, "p, q") in rows and ("pair", "ENTITY-A", "LIST", "[a,\nb]") in rows
    again = documents.nodes(documents.serialise(n, "PACK"))
    assert [(r.node_type, r.section, r.key, r.value) for r in again.orderBy("ord").collect()] == [x for x in rows]
    out = documents.serialise(n, "PACK", canonical=True, ascii_only=True).first().text
    assert out.index("DOMAIN:") < out.index("AUTHOR:") < out.index("SCOPE:") and "v->w" in out
    assert documents.parse("d", "no head")[0][4] == "error"
    assert "Identifier: id(UUID)." in documents.prose(n).first().text
    m = {r.section: r.n_keys for r in documents.manifest(n).collect()}
    assert m == {"ENTITY-A": 2, "ENTITY-A/SUB": 1}


def test_facts_become_a_document(spark, folder):
    n = documents.from_facts(corpus.facts(corpus.discover(spark, folder)), "pack", "sales")
    text = documents.serialise(n, "PACK").first().text
    assert text.startswith("§PACK v1.0 L2\nDOMAIN:sales\n\n±ENTITY-CUSTOMER\n★GOLDEN-SOURCE:CRM (west)")
    assert "±ENTITY-ORDER" in text


def test_section_numbers_and_references(spark):
    h = spark.createDataFrame([("p", 1, 1, "A"), ("p", 2, 2, "B"), ("p", 3, 2, "C"), ("p", 4, 3, "D"), ("p", 5, 1, "E"), ("p", 6, 2, "F")], "path string, line int, level int, heading string")
    s = markdown.section_numbers(h, "path", "line", "level")
    assert [r.number for r in s.orderBy("line").collect()] == ["1", "1.1", "1.2", "1.2.1", "2", "2.1"]
    t = spark.createDataFrame([("p", 1, "please see Section 1.2 and see section 9, then see Section 2."), ("p", 2, "none")], "path string, ord int, text string")
    assert [r.text for r in markdown.resolve_references(t, s).orderBy("ord").collect()] == ["please see Section 1.2 (C) and see section 9, then see Section 2 (E).", "none"]


PY = '''"""Doc."""
import os
from fastapi import APIRouter
LIMIT = 3
class Item(BaseModel):
    """An item."""
    def price(self) -> int:
        return compute(self)
@app.get("/items")
async def items(q: str = "x"):
    return helper.load(q)
def items(): pass
'''
TSX = 'import React from "react"\nexport const useThing = () => 1\nexport function Card() { return <b>x</b> }\nexport const MAX_SIZE = 4\nexport type Props = {}\nexport default function run() {}\n'


def test_code(spark):
    f = code.scan(spark.createDataFrame([("src/a.py", PY), ("src/bad.py", "def ("), ("web/b.tsx", TSX), ("node_modules/x.ts", "export const a = 1"), ("src/g.py", "# @generated\nx = 1"), ("tmp/t.py", "a = 1")], "path string, text string"), ["tmp/"])
    assert {r.path for r in f.collect()} == {"src/a.py", "src/bad.py", "web/b.tsx"}
    s = code.python_symbols(f)
    got = {(r.qname, r.kind) for r in s.collect()}
    assert {("Item", "class"), ("Item.price", "method"), ("items", "function"), ("items#1", "function"), ("LIMIT", "const"), ("os", "import"), ("<file>", "warning")} <= got
    assert [(r.method, r.route) for r in code.routes(s).collect()] == [("GET", "/items")]
    assert [r.qname for r in code.models(s).collect()] == ["Item"]
    assert {(r.caller, r.callee) for r in code.python_calls(f).collect()} >= {("Item.price", "compute"), ("items", "helper.load")}
    assert {(r.name, r.kind) for r in code.typescript_symbols(f).collect()} == {("useThing", "hook"), ("Card", "component"), ("MAX_SIZE", "const"), ("Props", "type"), ("run", "function")}
    assert [r.module for r in code.typescript_imports(f).collect()] == ["react"]


def test_events(spark, tmp_path):
    assert events.read(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"session_id": "s", "sections_matched": 2}\n\nnot json\n')
    assert [(r.session_id, r.sections_matched) for r in events.read(spark, str(tmp_path / "log")).collect()] == [("s", 2)]
    events.append(events.logged(spark.createDataFrame([("s", "why?")], "session_id string, question string")), str(tmp_path / "log"))
    assert events.read(spark, str(tmp_path / "log")).filter(F.length("question_hash") == 64).count() == 1


def test_trace(spark):
    rows = [("s", 0, [{"name": "my cart", "size": "3"}], None, None, None), ("s", 1, None, "look up", {"price": "4"}, None), ("s", 2, None, None, None, "buy"), ("s", 3, None, None, None, None)]
    t = events.trace_steps(spark.createDataFrame(rows, f"session_id string, step int, {events.TRACE}"))
    assert {(r.entity, r.key, r.value) for r in t.collect()} == {("MY-CART", "size", "3"), ("LOOK-UP", "price", "4"), ("DECISION-2", "decision", "buy"), ("STEP-3", None, None)}
