"""Packed documents: header, indentation-scoped sections, key-value lines. Parser to node rows, and serialisers from them.

Nodes: one row each with ``ord`` (order in the document), ``depth``, ``section`` (path of section names), ``node_type``,
``key``, ``value``. The text form begins with a line ``§NAME v1.0 L2 KEY:value ...``, header lines and a blank line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T

SHAPE = "doc string, ord int, depth int, section string, node_type string, key string, value string"
_COLS = [c.split()[0] for c in SHAPE.split(", ")]
_SECTION = re.compile(r"^(\s*)(?:±|##)\s?([A-Z][A-Z0-9_-]*)((?: .*)?)$")
_PAIR = re.compile(r"^([★⚠]?[A-Za-z_*][A-Za-z0-9_*-]*):(.*)$")
REQUIRED = ("COMPRESSED", "DOMAIN", "SOURCE_TOKENS")
RECOMMENDED = ("AUTHOR", "CTX_TOKENS", "GEN", "HASH", "PROVENANCE", "RATIO", "SCHEMA", "SCOPE", "SOURCE", "TURNS")


def parse(doc: str, text: str) -> list[tuple]:
    """Node rows; ill-formed lines become diagnostics (node_type ``error``) and parsing goes on."""
    out: list[tuple] = []
    add = lambda depth, section, kind, key, value: out.append((doc, len(out), depth, section, kind, key, value))
    lines = (text or "").replace("\r\n", "\n").split("\n")
    head = re.match(r"^[§$]\w+ (v\d+\.\d+) (L[0-3]|MANIFEST)(.*)$", lines[0]) if lines else None
    if not head:
        add(0, "", "error", "E001", "no status line")
        i = 0
    else:
        add(0, "", "status", head[1], head[2])
        for m in re.finditer(r"(\S+?):(\S+)", head[3]):
            add(0, "", "header", m[1], m[2])
        i = 1
        while i < len(lines) and lines[i].strip():
            m = _PAIR.match(lines[i])
            add(0, "", "header" if m else "error", m[1] if m else "E002", m[2].strip() if m else lines[i])
            i += 1
    stack: list[tuple[int, str]] = []
    while i < len(lines):
        line = lines[i]
        i += 1
        s = line.strip()
        if not s:
            continue
        indent = len(line) - len(line.lstrip(" "))
        m = _SECTION.match(line)
        if m:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append((indent, m[2]))
            add(len(stack), "/".join(n for _, n in stack), "section", m[2], m[3].strip())
            continue
        while len(stack) > 1 and stack[-1][0] > indent:
            stack.pop()
        at, depth = "/".join(n for _, n in stack), len(stack) + 1
        if s.startswith("```"):
            body = []
            while i < len(lines) and not lines[i].strip().startswith("```"):
                body.append(lines[i])
                i += 1
            add(depth, at, "quoted", s[3:], "\n".join(body))
            if i >= len(lines):
                add(depth, at, "error", "E003", "open quote")
            i += 1
            continue
        if s.startswith("SRC:"):
            add(depth, at, "provenance", "SRC", s[4:].strip())
        elif m := re.match(r"^(\d+)\.\s*(.+)$", s):
            add(depth, at, "numbered", m[1], m[2])
        elif m := _PAIR.match(s):
            value = m[2]
            while value.count("[") > value.count("]") and i < len(lines) and lines[i].strip():  # a list over several lines
                value += "\n" + lines[i].strip()
                i += 1
            add(depth, at, "pair", m[1], value)
        elif s.startswith("[") and s.endswith("]"):
            add(depth, at, "list", None, s[1:-1])
        else:
            add(depth, at, "line", None, s)
    return out


def nodes(texts: DataFrame) -> DataFrame:
    """Node rows of (doc, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for d, t in zip(b.doc, b.text) for r in parse(d, t)], columns=_COLS)

    return texts.select("doc", "text").mapInPandas(run, SHAPE)


def _line(name: str, value: Column) -> Column:
    """The text of a node."""
    pad = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("depth") - 2))
    head = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("depth") - 1))
    return (
        F.when(F.col("node_type") == "status", F.concat(F.lit(f"§{name} "), "key", F.lit(" "), value))
        .when(F.col("node_type") == "header", F.concat("key", F.lit(":"), value))
        .when(F.col("node_type") == "section", F.concat(F.when(F.col("first_"), F.lit("\n")).otherwise(F.lit("")), head, F.lit("±"), "key", F.when(value != "", F.concat(F.lit(" "), value)).otherwise(F.lit(""))))
        .when(F.col("node_type") == "pair", F.concat(pad, "key", F.lit(":"), value))
        .when(F.col("node_type") == "numbered", F.concat(pad, "key", F.lit(". "), value))
        .when(F.col("node_type") == "list", F.concat(pad, F.lit("["), value, F.lit("]")))
        .when(F.col("node_type") == "quoted", F.concat(F.lit("```"), "key", F.lit("\n"), value, F.lit("\n```")))
        .when(F.col("node_type") == "provenance", F.concat(pad, F.lit("SRC:"), value))
        .when(F.col("node_type") == "line", F.concat(pad, value))
    )


def header_rank(key: Column) -> Column:
    """Required fields, then recommended ones, then the rest; inside these, keys decide."""
    return F.when(key.isin(*REQUIRED), 0).when(key.isin(*RECOMMENDED), 1).otherwise(2)


def serialise(n: DataFrame, name: str = "DOC", canonical: bool = False, ascii_only: bool = False, plain_words: bool = False) -> DataFrame:
    """(doc, text). Canonical orders header lines by rank and key; ASCII replaces signs; plain words drop hyphens."""
    value = F.coalesce("value", F.lit(""))
    if plain_words:
        value = F.when(F.col("node_type").isin("pair", "line"), T.dehyphenated(value)).otherwise(value)
    is_head = F.col("node_type") == "header"
    place = F.struct(F.when(F.col("node_type") == "status", 0).when(is_head, 1).otherwise(2).alias("a"), F.when(is_head & F.lit(canonical), header_rank(F.col("key"))).otherwise(0).alias("b"), F.when(is_head & F.lit(canonical), F.col("key")).otherwise("").alias("c"), F.col("ord").alias("d"))
    first = n.filter("node_type = 'section'").groupBy("doc").agg(F.min("ord").alias("first_ord"))
    rows = n.filter("node_type <> 'error'").join(first, "doc", "left").withColumn("first_", F.col("ord") == F.col("first_ord")).select("doc", place.alias("place"), _line(name, value).alias("line"))
    g = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    return g.select("doc", (T.ascii_form(text) if ascii_only else text).alias("text"))


def provenance(fields: DataFrame) -> DataFrame:
    """(entity, key, sources): where each field came from, joined by +, in order of (entity, ord, key, source)."""
    g = fields.groupBy("entity", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("s"))
    return g.select("entity", "key", F.array_join(F.array_distinct(F.transform("s", lambda x: x["source"])), " + ").alias("sources"))


def with_inline_sources(n: DataFrame, source: Column) -> DataFrame:
    return n.withColumn("value", F.when((F.col("node_type") == "pair") & source.isNotNull(), F.concat("value", F.lit("  SRC:"), source)).otherwise(F.col("value")))


def from_facts(facts: DataFrame, doc: str, domain: str) -> DataFrame:
    """Node rows of extracted facts: entities by salience (sources, references, warnings), their fields by salience."""
    from pyspark.sql import Window

    from lorespark.operators import resolve as R

    fields = facts.filter("kind = 'field'").withColumn("s_", R.field_salience(F.col("key"), F.col("value")))
    refs = R.reference_counts(fields, "value").withColumnRenamed("refs", "xrefs")
    warned = facts.filter("kind = 'warning' AND entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("warnings"))
    e = facts.filter("kind = 'entity'").groupBy("entity").agg(F.countDistinct("path").alias("sources"), F.max("value").alias("about"))
    golden = fields.filter("key = '★GOLDEN-SOURCE'").select("entity").distinct().withColumn("golden", F.lit(True))
    e = R.entity_salience(e.join(refs, "entity", "left").join(warned, "entity", "left").join(golden, "entity", "left").na.fill(0, ["xrefs", "warnings"]).na.fill(False, ["golden"]))
    sizes = fields.groupBy("entity").agg(F.count("*").alias("n"))
    ranked = Window.orderBy(F.col("salience").desc(), "entity")  # entities only: a row each, however many facts they have
    before = F.coalesce(F.sum(F.coalesce("n", F.lit(0)) + 1).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.join(sizes, "entity", "left").withColumn("place", (before + 2).cast("int"))
    name = F.concat(F.lit("ENTITY-"), "entity")
    heads = e.select(F.col("place").alias("ord"), F.lit(1).alias("depth"), name.alias("section"), F.lit("section").alias("node_type"), name.alias("key"), F.lit("").alias("value"))
    inside = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("s_").desc(), "ord", "path"))
    pairs = fields.join(e.select("entity", "place"), "entity").select((F.col("place") + inside).alias("ord"), F.lit(2).alias("depth"), name.alias("section"), F.lit("pair").alias("node_type"), "key", "value")
    head = facts.sparkSession.createDataFrame([(0, 0, "", "status", "v1.0", "L2"), (1, 0, "", "header", "DOMAIN", domain)], "ord int, depth int, section string, node_type string, key string, value string")
    return head.unionByName(heads).unionByName(pairs).select(F.lit(doc).alias("doc"), "ord", "depth", "section", "node_type", "key", "value")


def manifest(n: DataFrame) -> DataFrame:
    """(doc, section, n_keys, keys, words): up to eight keys, then how many more; words of the values."""
    p = n.filter("node_type = 'pair'").groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("ord", "key"))).alias("s"), F.sum(T.word_count(F.col("value"))).alias("words"))
    keys = F.transform("s", lambda x: x["key"])
    more = F.when(F.size("s") > 8, F.concat(F.lit("+"), (F.size("s") - 8).cast("string"))).otherwise(F.lit(None))
    return p.select("doc", "section", F.size("s").alias("n_keys"), F.concat_ws(",", F.array_join(F.slice(keys, 1, 8), ","), more).alias("keys"), "words")


def prose(n: DataFrame) -> DataFrame:
    """(doc, text): sections as headings, labels in title case, signs as words, references by name."""
    label = F.initcap(F.regexp_replace(F.lower(F.regexp_replace("key", "^[★⚠]", "")), "[-_]", " "))
    v = F.regexp_replace("value", "@ENTITY-([A-Z0-9-]+)", "the $1 entity")
    for sign, word in (("→", " then "), ("|", "; "), ("¬", "not "), ("1:N", "one to many"), ("1:1", "one to one"), ("+", ", ")):
        v = F.replace(v, F.lit(sign), F.lit(word))
    line = F.when(F.col("node_type") == "section", F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), label)).when(F.col("node_type") == "pair", F.concat(label, F.lit(": "), v, F.lit("."))).when(F.col("node_type").isin("line", "numbered", "list"), v)
    g = n.withColumn("line", line).filter("line IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("s"))
    return g.select("doc", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


def indexes(n: DataFrame, kinds: int = 15) -> DataFrame:
    """(doc, index, key, value): the manifest's section index (words and up to eight keys), entity index and keyword index of top-level sections.

    Keywords are the keys, the entities referred to and the terms of the domain, lower-cased; the first ``kinds`` in order of the alphabet.
    """
    p = n.filter("section <> ''").withColumn("top", F.substring_index("section", "/", 1))
    value = F.coalesce("value", F.lit(""))
    pair, words = F.col("node_type") == "pair", T.word_count(F.concat_ws(" ", F.when(F.col("node_type") == "pair", F.col("key")), value))
    refs = F.transform(F.regexp_extract_all(value, F.lit("@(?:ENTITY-)?([A-Za-z0-9_][A-Za-z0-9_-]*)"), 1), F.lower)
    own = F.regexp_extract("top", "^ENTITY-(.+)$", 1)
    terms = F.concat(F.when(pair, F.array(F.lower("key"))).otherwise(F.array().cast("array<string>")), refs, T.semantic_keywords(value), F.when(own != "", F.array(F.lower(own))).otherwise(F.array().cast("array<string>")))
    g = p.groupBy("doc", "top").agg(
        F.sum(F.when(F.col("node_type") == "section", 0).otherwise(words)).alias("w"), F.array_sort(F.collect_list(F.when(pair, F.struct("ord", "key")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(terms)))).alias("t"),
    )
    tok, keys = F.concat(F.lit("~"), (F.col("w") + 1).cast("string"), F.lit("tok")), F.transform("s", lambda x: x["key"])
    more = F.when(F.size("s") > 8, F.concat(F.lit(",+"), (F.size("s") - 8).cast("string"))).otherwise("")
    rows = F.array(
        F.struct(F.lit("SECTION-INDEX").alias("index"), F.col("top").alias("key"), F.concat(tok, F.lit(" keys:["), F.array_join(F.slice(keys, 1, 8), ","), more, F.lit("]")).alias("value")),
        F.when(F.col("top").startswith("ENTITY-"), F.struct(F.lit("ENTITY-INDEX").alias("index"), F.substring_index("top", "ENTITY-", -1).alias("key"), F.concat(F.lit("±"), "top", F.lit(" "), tok).alias("value"))),
        F.when(F.size("t") > 0, F.struct(F.lit("KEYWORD-INDEX").alias("index"), F.col("top").alias("key"), F.array_join(F.slice("t", 1, kinds), ",").alias("value"))),
    )
    return g.select("doc", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def overview(n: DataFrame, hub: int = 3, budget: int = 500) -> DataFrame:
    """(doc, part, ord, text): entities with role, identifier and owners; topology; patterns; constraints by weight; warnings.

    Beyond ``budget`` words the last lines of constraints go first, then those of patterns.
    """
    from pyspark.sql import Window

    p = n.filter("node_type = 'pair' AND section LIKE 'ENTITY-%'").withColumn("e", F.regexp_extract("section", "^ENTITY-([^/]+)", 1))
    e = n.filter("node_type = 'section' AND section LIKE 'ENTITY-%' AND section NOT LIKE '%/%'").select("doc", F.regexp_extract("section", "^ENTITY-(.+)$", 1).alias("e"), F.col("ord").alias("at"))
    edges = p.select("doc", "e", F.explode(F.regexp_extract_all("value", F.lit("@ENTITY-([A-Za-z0-9_][A-Za-z0-9_-]*)"), 1)).alias("to")).filter("e <> to")
    inbound = edges.groupBy("doc", F.col("to").alias("e")).agg(F.count("*").alias("n"))
    e = e.join(inbound, ["doc", "e"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    e = e.withColumn("role", F.when(F.col("n") >= hub, "hub").when(F.col("n") == 0, "leaf").otherwise("bridge"))
    said = p.groupBy("doc", "e").agg(F.min_by(F.when(F.col("key") == "IDENTIFIER", F.col("value")), F.when(F.col("key") == "IDENTIFIER", F.col("ord"))).alias("id"), F.array_sort(F.collect_list(F.when(F.col("key").startswith("BELONGS-TO"), F.struct("ord", "value")))).alias("own"))
    line = F.concat_ws(" | ", F.concat("e", F.lit("("), "role", F.lit(")")), F.concat(F.lit("id:"), "id"), F.array_join(F.transform("own", lambda x: F.concat(F.lit("→"), x["value"])), " | "))
    entities = e.join(said, ["doc", "e"], "left").select("doc", F.lit("ENTITIES").alias("part"), F.col("at").alias("ord"), F.regexp_replace(line, " \\| $", "").alias("text"))
    groups = e.groupBy("doc").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("at", "e")))), lambda x: x["e"]), "+").alias(r) for r in ("hub", "leaf", "bridge")], F.count("*").alias("k"), F.sum("n").alias("edges"))
    lines = F.array(*[F.when(F.col(r) != "", F.concat(F.lit(f"{label}:"), F.col(r))) for r, label in (("hub", "HUBS"), ("leaf", "LEAVES"), ("bridge", "BRIDGES"))], F.concat(F.lit("GRAPH:"), F.col("k").cast("string"), F.lit("-entities,"), F.col("edges").cast("string"), F.lit("-edges")))
    topology = groups.select("doc", F.lit("TOPOLOGY").alias("part"), F.posexplode(F.array_compact(lines)).alias("ord", "text"))
    v, key = F.col("value"), F.col("key")
    tag = lambda mark, x: F.concat("e", F.lit(f":{mark}→"), x)
    rules = F.when(v.startswith("["), F.size(F.split(v, ","))).otherwise(1)
    units = F.create_map(*[F.lit(x) for x in ("d", "days", "w", "weeks", "m", "months")])
    window, guard = F.regexp_extract(v, "±([0-9]+)([dwm])\\b", 1), F.regexp_extract(v, "\\b(?:only-if|when|if)\\([^)]+\\)", 0)
    found = F.array(
        F.when(key == "STATUS-MACHINE", F.struct(F.lit(0).alias("w"), tag("STATUS", v).alias("t"))), F.when(key == "MATCH-RULES", F.struct(F.lit(0).alias("w"), F.concat("e", F.lit(":MATCH("), rules.cast("string"), F.lit("-rules)")).alias("t"))),
        F.when(key == "RETENTION", F.struct(F.lit(0).alias("w"), tag("RETENTION", v).alias("t"))),
        F.when(window != "", F.struct(F.lit(2).alias("w"), F.concat(F.lit("WINDOW:"), "e", F.lit(":"), key, F.lit("→±"), window, F.element_at(units, F.regexp_extract(v, "±([0-9]+)([dwm])\\b", 2))).alias("t"))),
        F.when(guard != "", F.struct(F.lit(3).alias("w"), F.concat(F.lit("GUARD:"), "e", F.lit(":"), key, F.lit("→"), guard).alias("t"))),
    )
    shown = p.select("doc", "ord", F.explode(F.array_compact(found)).alias("f")).select("doc", "ord", "f.w", "f.t")
    kinds = p.filter("key = 'IDENTIFIER'").withColumn("k", F.trim(F.regexp_extract("value", "\\(([^,)]+)", 1))).filter("k <> ''").groupBy("doc", "k").agg(F.count("*").alias("n"), F.min("ord").alias("at"))
    common = kinds.groupBy("doc").agg(F.max_by(F.struct("k", "n"), F.struct("n", (-F.col("at")).alias("a"))).alias("b")).join(groups.select("doc", F.col("k").alias("all")), "doc")
    shown = shown.unionByName(common.select("doc", F.lit(0).alias("ord"), F.lit(1).alias("w"), F.concat(F.lit("ID-PATTERN:"), F.col("b.n").cast("string"), F.lit("/"), F.col("all").cast("string"), F.lit("→"), "b.k").alias("t")))
    weight = F.when(key.isin("PII", "PII-CLASSIFICATION"), 0).when(key == "IMMUTABLE-AFTER", 1).when(key.startswith("★"), 2).when(v.contains("⚠"), 3)
    bound = p.withColumn("w", weight).filter("w IS NOT NULL").select("doc", "ord", "w", F.concat("e", F.lit(":"), key, F.lit("→"), F.when(weight == 3, F.concat(F.lit("⚠"), v)).otherwise(v)).alias("t"))
    warned = n.filter("node_type = 'line' AND value LIKE '%⚠%'").select("doc", "ord", F.lit(0).alias("w"), F.col("value").alias("t"))
    rest = [d.select("doc", F.lit(name).alias("part"), F.row_number().over(Window.partitionBy("doc").orderBy("w", "ord", "t")).alias("ord"), F.col("t").alias("text")) for d, name in ((shown, "PATTERNS"), (bound, "CONSTRAINTS"), (warned, "WARNINGS"))]
    whole = entities.unionByName(topology)
    for d in rest:
        whole = whole.unionByName(d)
    order = F.when(F.col("part") == "CONSTRAINTS", 2).when(F.col("part") == "PATTERNS", 1).otherwise(0)
    used = F.sum(T.word_count(F.col("text"))).over(Window.partitionBy("doc").orderBy(order, "part", "ord").rowsBetween(Window.unboundedPreceding, 0))
    return whole.withColumn("used_", used).filter((order == 0) | (F.col("used_") <= budget)).drop("used_")


def to_json(n: DataFrame) -> DataFrame:
    """(doc, json): header, and the body with sections nested as far as they go."""
    import json
    from collections.abc import Iterator

    def tree(rows: list[tuple]) -> str:
        head, fields = {"magic": "§", "version": "1.0", "layer": "L2", "fields": {}}, {}
        body: list[dict] = []
        at: list[tuple[int, list]] = [(0, body)]
        for _, depth, section, kind, key, value in sorted(rows, key=lambda r: r[0]):
            if kind == "status":
                head["version"], head["layer"] = (key or "").lstrip("v"), value
            elif kind == "header":
                fields[key] = value
            elif kind == "section":
                while len(at) > 1 and at[-1][0] >= depth:
                    at.pop()
                at[-1][1].append(x := {"type": "section", "name": section.rsplit("/", 1)[-1], "subtitles": (value or "").split(), "depth": depth, "children": []})
                at.append((depth, x["children"]))
            elif kind != "error":
                shape = {"pair": ("kv", "key", "value"), "numbered": ("numbered", "number", "text"), "quoted": ("quoted", "lang", "content"), "provenance": ("provenance", "path", "source")}.get(kind)
                at[-1][1].append({"type": shape[0], shape[1]: key, shape[2]: value} if shape else {"type": "plain", "text": value})
        return json.dumps({"header": head | {"fields": fields}, "body": body}, ensure_ascii=False, indent=2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "json": [tree([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows]) for rows in b["rows"]]})

    g = n.groupBy("doc").agg(F.collect_list(F.struct("ord", "depth", "section", "node_type", "key", "value")).alias("rows"))
    return g.mapInPandas(run, "doc string, json string")


def system_prompt(n: DataFrame, instructions: bool = True) -> DataFrame:
    """(doc, text): a directory of entities with their identifiers, for a model that fetches sections itself."""
    top = n.filter("section <> '' AND section NOT LIKE '%/%'")
    ids = F.min_by(F.when((F.col("node_type") == "pair") & (F.col("key") == "IDENTIFIER"), F.col("value")), F.when(F.col("key") == "IDENTIFIER", F.col("ord")))
    s = top.groupBy("doc", "section").agg(F.min("ord").alias("ord"), ids.alias("id"))
    is_entity = F.col("section").startswith("ENTITY-")
    line = F.when(is_entity, F.concat(F.lit("- "), "section", F.coalesce(F.concat(F.lit(" (id: "), "id", F.lit(")")), F.lit("")))).otherwise(F.concat(F.lit("- "), "section"))
    g = s.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((~is_entity).alias("rest"), "ord", line.alias("line")))).alias("s"))
    intro = F.lit("A knowledge base is at hand; ask for a section by its name to read it." if instructions else "")
    return g.select("doc", F.concat_ws("\n", F.nullif(intro, F.lit("")), F.array_join(F.transform("s", lambda x: x["line"]), "\n")).alias("text"))
