"""Golden cases of the scalar rules: what each must say, written out, apart from the code and its SQL."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import evaluate, graph, guard, resolve, retrieval
from lorespark.sources import code, documents


def said(spark, f, *args):
    row = spark.createDataFrame([tuple(args)], [f"c{i}" for i in range(len(args))])
    return row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("The order is not yet in the system.", "order yet system."), ("it is", "it is"), ("Each, every; any!", "Each, every; any!"), ("(the) cat", "(the) cat"), ("Their data was really here", "Their data really here"),
])
def test_fillers(spark, text, want):
    assert said(spark, T.without_fillers, text) == want


@pytest.mark.parametrize("text,want", [("§CTX v1", "$CTX v1"), ("±A → B ¬x", "##A -> B !x"), ("★G ⚠W ≡ ⊥", "***G WARN:W === CONFLICT:"), ("≥ … ×", "≥ … ×"), ("§2", "$CTX2")])
def test_ascii_forms(spark, text, want):
    assert said(spark, T.ascii_form, text) == want


@pytest.mark.parametrize("text,want", [
    ("Customer-matching-critical", "Customer matching critical"), ("FK→@ENTITY-A-B", "FK→@ENTITY-A-B"), ("see-@ENTITY-ORDER-LINE,-then-stop", "see @ENTITY-ORDER-LINE, then stop"), ("36-48 one-two", "36-48 one two"),
    ("SOURCE_TOKENS-CTX_TOKENS kept-words", "SOURCE_TOKENS-CTX_TOKENS kept words"), ("X-Y", "X Y"), ("a -- b", "a b"),
])
def test_dehyphenated(spark, text, want):
    assert said(spark, T.dehyphenated, text) == want


@pytest.mark.parametrize("key,value,want", [
    ("IDENTIFIER", "id of several words", True), ("★GOLDEN-SOURCE", "the CRM of sales", True), ("GOLDEN-SOURCE", "the CRM of sales", False), ("PII", "name and email", False), ("FLAG", " Enabled ", True), ("STATE", "Phase-II", True),
    ("STATE", "a-single-token-of-twenty-characters", False), ("NOTE", "two words", False), ("EMPTY", "  ", False),
])
def test_must_preserve(spark, key, value, want):
    assert said(spark, resolve.must_preserve, key, value) is want


@pytest.mark.parametrize("key,value,want", [
    ("NOTE", "plain", 1.0), ("BELONGS-TO", "x", 1.2), ("★NOTE", "x", 2.0), ("NOTE", "★ in the value", 1.0), ("NOTE", "⚠ mind", 1.5), ("PII-CLASSIFICATION", "high", 1.3), ("RETENTION", "±30d window", 1.1), ("RETENTION", "±30days", 1.0), ("RULE", "only-if(a) and b", 1.3), ("RULE", "notif(a)", 1.0),
])
def test_field_salience(spark, key, value, want):
    assert said(spark, resolve.field_salience, key, value) == pytest.approx(want)


@pytest.mark.parametrize("answer,want", [("", True), (None, True), ("NOT FOUND IN CONTEXT", True), ("We cannot determine that.", True), ("(error: timeout)", True), ("I don't know", False), ("It is unclear", False), ("36 months", False), ("There is no information about it", True)])
def test_needs_more(spark, answer, want):
    assert spark.range(1).select(guard.needs_more(F.lit(answer).cast("string")).alias("x")).first()["x"] is want


@pytest.mark.parametrize("question,want", [("How many orders?", True), ("Give me an OVERVIEW", True), ("what  entities do we have", True), ("What tables do we have", False), ("", False), ("Show one order", False), ("list all fields", True), ("Which entities exist?", False)])
def test_catalog_intent(spark, question, want):
    assert said(spark, guard.is_catalog_query, question) is want


@pytest.mark.parametrize("answer,signals,unknown,advice", [
    ("ENTITY-ORDER has 3 lines", 0, 0, "ok"), ("Generally speaking, yes", 1, 0, "warn"), ("See ENTITY-GHOST", 0, 1, "retry"), ("See ENTITY-GHOST and AB-99", 0, 2, "new_session"), ("From industry experience, ENTITY-GHOST", 1, 1, "retry"), ("ABCD-1 is no id", 0, 0, "ok"), ("as I mentioned earlier", 0, 0, "ok"),
])
def test_guard(spark, answer, signals, unknown, advice):
    rows = guard.guard(spark.createDataFrame([(answer,)], "a string"), "a", F.array(F.lit("ENTITY-ORDER"), F.lit("AB-12")))
    r = rows.withColumn("say", guard.correction(F.col("advice"), F.col("signals"), F.col("unknown"), F.array(F.lit("ENTITY-ORDER")))).first()
    assert (len(r["signals"]), len(r["unknown"]), r["advice"]) == (signals, unknown, advice)
    assert (r["say"] == "") == (advice == "ok") and ("ENTITY-ORDER" in r["say"]) == (unknown > 0)
    assert guard.guard(spark.createDataFrame([(answer,)], "a string"), "a").first()["unknown"] == []


@pytest.mark.parametrize("answer,expected,want", [
    ("The retention is 36 months.", "36-months", True), ("locale settings", "local", True), ("nothing here", "customer matching", False), ("Customer records match", "customer matching rules", True), ("The context does not mention it", "NOT_IN_CONTEXT", True), ("It is 5", "NOT_IN_CONTEXT", False),
    ("", "x", False), ("x", "", False), ("it is 7", "7", True), ("it is 8", "7", False),
])
def test_answer_matches(spark, answer, expected, want):
    assert said(spark, evaluate.answer_matches, answer, expected) is want


def test_prices(spark):
    rows = spark.createDataFrame([("gpt-4o", 2000), ("claude-haiku-4-5", 1000), ("gemini-2.5-flash-lite", 9), ("unheard-of", 1000)], "m string, n long")
    assert {r["m"]: round(r["cost"], 9) for r in evaluate.token_cost(rows, "n", "m").collect()} == {"gpt-4o": 0.005, "claude-haiku-4-5": 0.001, "gemini-2.5-flash-lite": 0.0, "unheard-of": 0.003}


def test_topology_goes_by_inbound_edges(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "node string")
    edges = spark.createDataFrame([("A", "B"), ("C", "B"), ("D", "B"), ("B", "C")], "src string, dst string")
    assert {r["node"]: r["role"] for r in graph.topology(nodes, edges).collect()} == {"A": "leaf", "B": "hub", "C": "bridge", "D": "leaf"}


def plain_pagerank(nodes, edges, boosted=(), boost=3.0, rounds=30):
    n, score = len(nodes), dict.fromkeys(nodes, 1 / len(nodes))
    outs = {x: [d for s, d in edges if s == x] for x in nodes}
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.15 / n)
        for x in nodes:
            mass = score[x] * (boost if x in boosted else 1)
            for d in outs[x] or nodes:
                new[d] += 0.85 * mass / len(outs[x] or nodes)
        score = {x: v / sum(new.values()) for x, v in new.items()}
    return score


def test_boosted_callers_pass_on_more(spark):
    nodes, edges = ["a", "b", "c", "t"], [("t", "a"), ("c", "b"), ("c", "b"), ("a", "c"), ("a", "a")]
    n, e, b = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("t",)], "node string")
    for boosted, given in (((), None), (("t",), b)):
        got = {r["node"]: r["score"] for r in graph.pagerank(n, e, boosted=given).collect()}
        assert got == pytest.approx(plain_pagerank(nodes, edges, boosted)) and sum(got.values()) == pytest.approx(1)


def test_typescript_kinds(spark):
    src = """import React from 'react'
export function useThing() { return 1 }
function Card() { return <div className="x">hi</div> }
export function Total() { return 1 }
export const Fancy = memo(Card)
const Row = () => <Card />
export const MAX_SIZE = 10
export const useOther = () => 2
export class Store {}
interface Props { a: string }
type T = Array<string>
"""
    got = {r["name"]: r["kind"] for r in code.typescript_symbols(spark.createDataFrame([("a.tsx", src)], "path string, text string")).collect()}
    assert got == {"useThing": "hook", "Card": "component", "Total": "function", "Fancy": "component", "Row": "component", "MAX_SIZE": "const", "useOther": "hook", "Store": "class", "Props": "type", "T": "type"}


def test_header_order(spark):
    text = "§CTX v1.0 L2 ZED:1 SCOPE:a DOMAIN:d AUTHOR:me SOURCE_TOKENS:5 COMPRESSED:x\n"
    got = documents.serialise(documents.nodes(spark.createDataFrame([("x", text)], "doc string, text string")), canonical=True).first()["text"] if hasattr(documents, "nodes") else None
    keys = spark.createDataFrame([(k,) for k in "ZED SCOPE DOMAIN AUTHOR SOURCE_TOKENS COMPRESSED".split()], "k string").orderBy(documents.header_rank(F.col("k")), "k")
    assert [r["k"] for r in keys.collect()] == ["COMPRESSED", "DOMAIN", "SOURCE_TOKENS", "AUTHOR", "SCOPE", "ZED"]
    assert got is None or got.index("COMPRESSED") < got.index("DOMAIN") < got.index("AUTHOR") < got.index("ZED")


def test_chunks_go_by_paragraph_then_sentence(spark):
    assert retrieval.chunk_text("", 5) == [] and retrieval.chunk_text("a b\n\n\nc d", 5) == ["a b\n\nc d"]
    assert retrieval.chunk_text("a b c\n\nd e f\n\ng h", 5) == ["a b c", "a b c\n\nd e f", "d e f\n\ng h"]
    assert retrieval.chunk_text("a b c\n\nd e f\n\ng h", 5, 0) == ["a b c", "d e f\n\ng h"]
    assert retrieval.chunk_text("one\n\na b c. d e f. g h i! j k", 6) == ["one", "a b c. d e f.", "a b c. d e f. g h i!", "a b c. d e f. g h i! j k"]
    assert retrieval.chunk_text("w " * 20, 6) == ["w " * 19 + "w"]
    got = retrieval.chunks(spark.createDataFrame([(1, "a b c\n\nd e f"), (2, None)], "id long, text string"), "id", "text", 5).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a b c"), (1, 1, "a b c\n\nd e f")]


def test_keywords_of_several_words_and_with_hyphens(spark):
    k = spark.createDataFrame([(1, "data-quality"), (2, "Data"), (3, "quality rules now")], "kid long, keyword string")
    t = spark.createDataFrame([(7, "Data quality rules: DATA-QUALITY, dataquality"), (8, "quality rules now now")], "tid long, text string")
    assert {tuple(r) for r in retrieval.keyword_hits(k, t, "kid", "tid").collect()} == {(1, 7, 2), (2, 7, 2), (3, 8, 1)}


def test_bm25_terms_by_shuffle(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red fox"), (2, "blue")], "q long, text string")
    d = spark.createDataFrame([(1, "red red fox jumps"), (2, "a fox"), (3, "nothing")], "d long, text string")
    rows = lambda: sorted(tuple(r) for r in retrieval.bm25(q, d, "q", "d").collect())
    want = rows()
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
    assert rows() == want and [r[:2] for r in want] == [(1, 1), (1, 2)]
