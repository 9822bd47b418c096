"""Compression of extracted facts into a document under a budget: presets, field decisions, expansion, agent state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.cuts import cut
from lorespark.operators import resolve as R


@dataclass(frozen=True)
class Preset:
    """``ratio``: source words for a word of output at most; ``floor``: words an entity at least; fields below ``drop_below`` go, or are
    shortened from half of it where ``shorten``."""

    ratio: float
    floor: int
    drop_below: float
    shorten: bool = False


PRESETS = {"aggressive": Preset(15.0, 5, 0.6, True), "balanced": Preset(10.0, 15, 0.3), "conservative": Preset(5.0, 30, 0.0)}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}: {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def field_decision(key: Column, value: Column, salience: Column, p: Preset, keep: tuple[str, ...] = ()) -> Column:
    """include, abbreviate or drop."""
    low = F.when(F.lit(p.shorten) & (salience >= p.drop_below * 0.5), "abbreviate").otherwise("drop")
    return F.when(R.must_preserve(key, value) | key.isin(*keep) | (salience >= p.drop_below), "include").otherwise(low)


def entity_budgets(entities: DataFrame, p: Preset, source_words: int, total: int = 0) -> DataFrame:
    """Adds ``budget``: each entity's share of the total by salience, the preset's floor at least. Without a total, the ratio gives one, 50 at least."""
    total = total or max(int((source_words or 1000) / p.ratio), 50)
    whole = F.broadcast(entities.agg(F.sum("salience").alias("whole_"), F.count("*").alias("n_")))  # one row
    share = F.when(F.col("whole_") > 0, F.col("salience") / F.col("whole_")).otherwise(1 / F.col("n_"))
    return entities.crossJoin(whole).withColumn("budget", F.greatest(F.floor(F.lit(total) * share), F.lit(p.floor)).cast("long")).drop("whole_", "n_")


def inferred_mark(value: Column) -> Column:
    """The value marked as inferred, inside its last parenthesis if it ends with one."""
    return F.when(value.endswith(")"), F.concat(F.regexp_replace(value, "\\)$", ""), F.lit("(inferred))"))).otherwise(F.concat(value, F.lit("(inferred)")))


def node_words(n: DataFrame) -> DataFrame:
    """(doc, serialised, tree): words as they are written, where key and value meet at a colon, and words of keys and values apart."""
    kind, value = F.col("node_type"), F.coalesce("value", F.lit(""))
    written = F.when(kind == "section", 1).when(kind == "pair", T.word_count(F.concat("key", F.lit(":"), value))).when(kind.isin("line", "numbered", "list", "provenance"), T.word_count(value)).otherwise(0)
    apart = F.when(kind == "section", 1).when(kind == "pair", T.word_count(F.col("key")) + T.word_count(value)).when(kind.isin("line", "numbered", "list", "quoted", "provenance"), T.word_count(value)).otherwise(0)
    return n.groupBy("doc").agg(F.sum(written).cast("long").alias("serialised"), F.sum(apart).cast("long").alias("tree"))


def compress(facts: DataFrame, domain: str, source_words: int, name: str = "", max_ratio: float = 0, floor: int = 0, keep: tuple[str, ...] = (), strict: bool = False, scope: str = "", author: str = "", day: str | None = None) -> DataFrame:
    """Document nodes of facts: entities and their fields by salience, rules, warnings, and a header with the sizes.

    A preset (``name``) decides field by field and sets ratio and floor. Where the result is smaller than those ask for, all fields
    come back, hyphens become blanks and entities get their descriptions.
    """
    p = preset(name) if name else None
    max_ratio, floor = (p.ratio, p.floor) if p else (max_ratio, floor)
    inferred = F.col("certainty") == "inferred"
    fields = facts.filter("kind = 'field' AND entity IS NOT NULL")
    fields = fields.filter(~inferred) if strict else fields.withColumn("value", F.when(inferred, inferred_mark(F.col("value"))).otherwise(F.col("value")))
    fields = fields.withColumn("s_", R.field_salience(F.col("key"), F.col("value")))
    fields = cut(fields.withColumn("action", field_decision(F.col("key"), F.col("value"), F.col("s_"), p, keep) if p else F.lit("include")), "decided")
    refs = R.reference_counts(fields, "value").withColumnRenamed("refs", "xrefs")
    warned = facts.filter("kind = 'warning' AND entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("warnings"))
    e = facts.filter("kind = 'entity'").groupBy("entity").agg(F.countDistinct("path").alias("sources"), F.max("value").alias("about"))
    golden = fields.filter("key = '★GOLDEN-SOURCE'").select("entity").distinct().withColumn("golden", F.lit(True))
    e = cut(R.entity_salience(e.join(refs, "entity", "left").join(warned, "entity", "left").join(golden, "entity", "left").na.fill(0, ["xrefs", "warnings"]).na.fill(False, ["golden"])), "entities")
    n_entities = e.count()

    def body(full: bool) -> DataFrame:
        shown = fields if full else fields.filter("action <> 'drop'").withColumn("value", F.when(F.col("action") == "abbreviate", T.abbreviated(F.col("value"))).otherwise(F.col("value")))
        shown = shown.withColumn("value", T.dehyphenated(F.col("value"))) if full else shown
        lines = shown.select("entity", F.struct((-F.col("s_")).alias("a"), "ord", "path").alias("o"), F.lit("pair").alias("node_type"), "key", "value")
        if full:
            about = e.filter("coalesce(about, '') <> ''").select("entity", F.struct(F.lit(-1e9).alias("a"), F.lit(0).alias("ord"), F.lit("").alias("path")).alias("o"), F.lit("line").alias("node_type"), F.lit(None).cast("string").alias("key"), F.col("about").alias("value"))
            lines = about.unionByName(lines)
        loose = facts.filter("kind IN ('rule', 'warning', 'note') AND entity IS NULL OR kind = 'warning'").select(F.concat(F.lit("~"), F.when(F.col("kind") == "warning", "WARNINGS").otherwise("RULES")).alias("entity"), F.struct(F.lit(0.0).alias("a"), "ord", "path").alias("o"), F.when(F.col("kind") == "rule", "pair").otherwise("line").alias("node_type"), F.when(F.col("kind") == "rule", F.col("key")).alias("key"), F.when(F.col("kind") == "warning", F.concat(F.lit("⚠ "), "value")).otherwise(F.col("value")).alias("value"))
        lines = lines.unionByName(loose)
        sizes = lines.groupBy("entity").agg(F.count("*").alias("n"))
        heads = e.select("entity", "salience").unionByName(loose.select("entity").distinct().withColumn("salience", F.lit(-1.0))).join(sizes, "entity", "left")
        ranked = Window.orderBy(F.col("salience").desc(), "entity")  # a row an entity, however many facts there are
        heads = heads.withColumn("place", (F.coalesce(F.sum(F.coalesce("n", F.lit(0)) + 1).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 100).cast("int"))
        section = F.when(F.col("entity").startswith("~"), F.expr("substring(entity, 2)")).otherwise(F.concat(F.lit("ENTITY-"), "entity"))
        inside = F.row_number().over(Window.partitionBy("entity").orderBy("o"))
        rows = lines.join(heads.select("entity", "place"), "entity").select((F.col("place") + inside).alias("ord"), F.lit(2).alias("depth"), section.alias("section"), "node_type", "key", "value")
        top = heads.select(F.col("place").alias("ord"), F.lit(1).alias("depth"), section.alias("section"), F.lit("section").alias("node_type"), section.alias("key"), F.lit("").alias("value"))
        return cut(top.unionByName(rows).select(F.lit(domain).alias("doc"), "ord", "depth", "section", "node_type", "key", "value"), "body")

    nodes = body(False)
    words = node_words(nodes).first()
    written = words["serialised"] if words else 0
    if written and (max_ratio and source_words / written > max_ratio or floor and n_entities and written / n_entities < floor):
        nodes = body(True)
        words = node_words(nodes).first()
        written = words["serialised"]
    ratio = f"~{source_words / written:.1f}x" if written and source_words else "~1x"
    head = [("status", "v1.0", "L2"), ("header", "DOMAIN", domain or "unknown"), ("header", "COMPRESSED", day or ""), ("header", "SOURCE_TOKENS", f"~{source_words}"), ("header", "CTX_TOKENS", f"~{words['tree'] if words else 0}"), ("header", "RATIO", ratio)]
    head += [("header", k, v) for k, v in (("SCOPE", scope), ("AUTHOR", author)) if v]
    rows = [(domain, i, 0, "", kind, k, v) for i, (kind, k, v) in enumerate(head)]
    return facts.sparkSession.createDataFrame(rows, nodes.schema).unionByName(nodes)


# ----- agent state
STEP_FACTS = "step int, path string, kind string, entity string, ord int, key string, value string, certainty string"


def step_facts(steps: DataFrame) -> DataFrame:
    """Facts of agent steps (step, json): observed entities, results of tools, decisions as rules."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    from lorespark.sources.extract import hyphened, name_of, short

    def of(step: int, raw: str) -> list[tuple]:
        try:
            s = json.loads(raw or "{}")
        except ValueError:
            return []
        out = []
        add = lambda kind, entity, key, value: out.append((step, f"step-{step}", kind, entity, len(out), key, value, "explicit"))
        found = [x for x in s.get("entities") or [] if isinstance(x, dict) and x.get("name")]
        if s.get("tool"):
            found.append({"name": f"TOOL-{s['tool']}"} | (s["result"] if isinstance(s.get("result"), dict) else {"result": s.get("result")}))
        for x in found:
            n = name_of(str(x["name"]))
            add("entity", n, "description", str(x.get("description") or ""))
            for k, v in x.items():
                if k not in ("name", "description") and v is not None:
                    add("field", n, hyphened(str(k)).upper(), short(v))
        if s.get("decision"):
            add("rule", None, f"DECISION-{step}", str(s["decision"]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in STEP_FACTS.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for i, j in zip(b["step"], b["json"]) for r in of(int(i), j)], columns=cols)

    return steps.select("step", "json").mapInPandas(run, STEP_FACTS)


def merged(facts: DataFrame) -> DataFrame:
    """Facts of repeated entities joined: the latest value of each field stays."""
    w = Window.partitionBy("kind", "entity", "key").orderBy(F.col("step").desc(), F.col("ord").desc())
    return facts.withColumn("k_", F.row_number().over(w)).filter("k_ = 1 OR kind = 'rule'").drop("k_")


def compress_steps(steps: DataFrame, domain: str = "agent-state", **how) -> tuple[DataFrame, dict]:
    """(nodes, metrics) of a whole trace: words before and after, ratio, entities merged, conflicting values, steps."""
    facts = cut(step_facts(steps), "steps")
    raw = steps.agg(F.sum(T.word_count(F.col("json"))).alias("w"), F.count("*").alias("n")).first()
    once = cut(merged(facts), "merged")
    named = facts.filter("kind = 'entity'").agg(F.count("*").alias("all"), F.countDistinct("entity").alias("own")).first()
    clash = facts.filter("kind = 'field'").groupBy("entity", "key").agg(F.countDistinct("value").alias("n")).filter("n > 1").count()
    nodes = compress(once, domain, raw["w"] or 0, **how)
    after = node_words(nodes).first()["tree"]
    metrics = {"tokens_raw": raw["w"] or 0, "tokens_compressed": after, "ratio": round((raw["w"] or 0) / after, 6) if after else 0.0, "entities_merged": named["all"] - named["own"], "conflicts": clash, "steps": raw["n"]}
    return nodes, metrics


class Session:
    """Rolling agent state over micro-batches of steps; entities of least salience, or the oldest, leave beyond the budget.

    Use as ``steps.writeStream.foreachBatch(session.update)``. The state is a table of facts in the folder that executors share.
    """

    def __init__(self, domain: str = "agent-state", budget: int = 4000, strategy: str = "lowest-salience"):
        self.domain, self.budget, self.strategy = domain, budget, strategy
        self.facts: DataFrame | None = None

    def update(self, steps: DataFrame, batch: int = 0) -> None:
        new = step_facts(steps)
        self.facts = cut(merged(new if self.facts is None else self.facts.unionByName(new)), "session")
        self.facts = cut(self._fitting(self.facts), "session")

    def _fitting(self, facts: DataFrame) -> DataFrame:
        fields = facts.filter("kind = 'field'")
        refs = R.reference_counts(fields, "value").withColumnRenamed("refs", "xrefs")
        size = fields.groupBy("entity").agg(F.sum(T.word_count(F.concat("key", F.lit(":"), "value"))).alias("w"))
        e = facts.filter("kind = 'entity'").groupBy("entity").agg(F.countDistinct("path").alias("sources"), F.min("step").alias("first"))
        e = e.join(refs, "entity", "left").join(size, "entity", "left").na.fill(0, ["xrefs", "w"]).withColumn("warnings", F.lit(0)).withColumn("golden", F.lit(False))
        order = [F.col("first").desc(), "entity"] if self.strategy == "oldest" else [F.col("salience").desc(), "entity"]
        used = F.sum(F.col("w") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # a row an entity of one agent
        kept = R.entity_salience(e).withColumn("used", used).filter(F.col("used") <= self.budget).select("entity")
        return facts.filter("entity IS NULL").unionByName(facts.filter("entity IS NOT NULL").join(kept, "entity", "left_semi").select(*facts.columns))

    def snapshot(self, **how) -> DataFrame:
        return compress(self.facts, self.domain, 0, **how)
