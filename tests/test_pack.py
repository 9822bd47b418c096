"""The entry points on a small corpus."""

import pytest

from lorespark import pack as P

FILES = {
    "customer.yaml": "entity: customer\naliases: [client]\nidentifier: {name: customer_id, type: UUID, required: true}\nnull_policy: customer_id(nullable)\nretention:\n  churned:\n    months: 36\n",
    "order.yaml": "entity: order\nidentifier: order_id\nbelongs_to: client\nretention: {closed: 7-years}\n",
    "notes.md": "# Entity: Clients\n## Tips\n- refund within thirty days\n",
}


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pack")
    for n, t in FILES.items():
        (d / n).write_text(t)
    return P.pack(spark, str(d), {"domain": "shop"})


def test_aliases_relationships_and_conflicts(packed):
    assert {r.entity for r in packed.facts.filter("kind = 'entity'").collect()} == {"CUSTOMER", "ORDER"}
    assert {(r.source, r.target, r.rel_type, r.certainty) for r in packed.relationships.collect()} == {("ORDER", "CUSTOMER", "belongs-to", "explicit"), ("CUSTOMER", "ORDER", "has-many", "inferred")}
    assert {(r.check, r.entity_a, r.entity_b, r.detail) for r in packed.conflicts.collect()} == {("retention", "CUSTOMER", "ORDER", "36 / 84"), ("null policy", "CUSTOMER", "CUSTOMER", "customer_id")}


def test_lookup_and_question(spark, packed):
    got = P.by_name(packed.nodes, ["entity-order", "ENTITY-CUSTOMER", "entity-order", "none"]).orderBy("ord").collect()
    assert [(r.ord, r.name) for r in got] == [(0, "entity-order"), (1, "ENTITY-CUSTOMER"), (2, "entity-order")]
    assert "RETENTION:closed→7-years" in got[0].text and got[0].layer == "rules"
    q = spark.createDataFrame([(1, "refund days?"), (2, "nothing here fits")], "qid int, text string")
    assert [(r.qid, r.section, r.score, r.rank) for r in P.by_question(packed.nodes, q).collect()] == [(1, "ENTITY-CUSTOMER", 1.0, 1)]
    assert {r.section for r in packed.sections().collect()} == {"ENTITY-CUSTOMER", "ENTITY-ORDER"}


def test_envelope():
    assert P.envelope("unknown_symbol", "no such section")["error"]["code"] == "unknown_symbol"
    with pytest.raises(ValueError):
        P.envelope("nope", "")
