"""Packed source trees: symbols ranked by centrality, bodies with their neighbours, raw files; errors as envelopes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.cuts import cut
from lorespark.operators import graph, retrieval
from lorespark.pack import envelope
from lorespark.sources import code

BUDGET = 4000  # estimated tokens of a symbol's neighbours


@dataclass
class CodePack:
    """``files`` (path, text), ``symbols`` (node, path, qname, kind, signature, doc, body, size, score), ``edges`` (src, dst)."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    outside: DataFrame  # paths that the rules exclude

    def list_symbols(self, module: str, k: int = 50) -> DataFrame | dict:
        """(qname, kind, score, rank) of a module, the most central first."""
        if k <= 0:
            return envelope("invalid_input", f"k is {k}", "ask for one symbol at least")
        own = self.symbols.filter(F.col("path") == module)
        if not self.files.filter(F.col("path") == module).limit(1).count():
            return envelope("unknown_module", f"{module} is not in the pack", "list the modules first")
        return retrieval.top_k(own, ["path"], [F.col("score").desc(), F.col("qname")], k).select("qname", "kind", "score", "rank")

    def search(self, question: str, k: int = 10, alpha: float = 0.5) -> DataFrame:
        """(qname, path, score): a blend of BM25 over names, signatures and comments, and of centrality, both as ranks."""
        q = self.symbols.sparkSession.createDataFrame([(1, question)], "qid int, text string")
        docs = self.symbols.select("node", F.concat_ws(" ", "qname", "signature", "doc").alias("text"))
        s = retrieval.bm25(q, docs, "qid", "node", T.identifier_tokens).join(self.symbols.select("node", "path", "qname", F.col("score").alias("central")), "node")
        n = retrieval.rank_normalised(retrieval.rank_normalised(s, ["qid"], "score", "r1"), ["qid"], "central", "r2")
        b = n.withColumn("score", F.round(retrieval.blend(F.col("r1"), F.col("r2"), alpha), 6))
        return retrieval.top_k(b, ["qid"], [F.col("score").desc(), F.col("node")], k).select("qname", "path", "score")

    def hydrate_symbol(self, name: str, depth: int = 0) -> DataFrame | dict:
        """(place, qname, path, body): the symbol, and with depth 1 its callers and callees as far as they fit."""
        if depth not in (0, 1):
            return envelope("invalid_input", f"depth is {depth}", "0 or 1")
        own = self.symbols.filter((F.col("qname") == name) | (F.col("node") == name))
        if not own.limit(1).count():
            return envelope("unknown_symbol", f"{name} is not in the pack", "search for it")
        first = own.select(F.lit(0).alias("place"), "qname", "path", "body")
        if not depth:
            return first
        near = graph.depth_one(own.select("node"), self.edges, self.symbols.select("node", "score", "size"), BUDGET).drop("start")
        return first.unionByName(near.join(self.symbols, "node").select(F.col("place").cast("int").alias("place"), "qname", "path", "body"))

    def raw_file(self, path: str) -> dict:
        """(path, content, bytes) of a packed file."""
        parts = path.replace("\\", "/").split("/")
        if ".." in parts or path.startswith("/") or (len(path) > 1 and path[1] == ":"):
            return envelope("path_outside_root", f"{path} leaves the pack's folder", "use a path below it")
        rel = "/".join(p for p in parts if p not in ("", "."))
        row = self.files.filter(F.col("path") == rel).select("text").first()
        if row is None:
            there = self.outside.filter(F.col("path") == rel).limit(1).count()
            return envelope("ignored_path", f"{rel} is excluded by the rules") if there else envelope("unknown_module", f"{rel} does not exist")
        return {"path": rel, "content": row["text"], "bytes": len(row["text"].encode())}


def ignore_rules(text: str) -> list[str]:
    """Patterns of an ignore file: comments, blank lines and negations are left out."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith(("#", "!"))]


def pack_codebase(files: DataFrame, ignore: list[str] = ()) -> CodePack:
    """Symbols, resolved calls and their ranks, tests counting threefold, of (path, text) rows; ignore files among them apply."""
    rules = [r for row in files.filter(F.col("path").rlike("(^|/)\\.[a-z]*ignore$")).select("text").toLocalIterator() for r in ignore_rules(row["text"] or "")]
    kept = cut(code.scan(files, [*ignore, *rules]).select("path", "text"), "files")
    python = code.python_symbols(kept).filter("kind NOT IN ('import', 'warning')")
    lines = F.slice(F.split("text", "\n"), F.col("line"), F.greatest(F.col("end") - F.col("line") + 1, F.lit(1)))
    python = python.join(kept, "path").withColumn("body", F.array_join(lines, "\n"))
    script = code.typescript_symbols(kept).select("path", F.col("name").alias("qname"), "kind", F.lit("").alias("signature"), F.lit("").alias("doc"), F.lit("").alias("body"))
    s = python.select("path", "qname", "kind", "signature", "doc", "body").unionByName(script)
    s = cut(s.withColumn("node", F.concat("path", F.lit(":"), "qname")).withColumn("size", T.estimated_tokens(F.col("body"))), "symbols")
    calls = code.python_calls(kept).select(F.concat("path", F.lit(":"), "caller").alias("caller"), "callee")
    by_name = s.select("node", "qname").groupBy("qname").agg(F.min("node").alias("dst"))
    edges = graph.resolve_callees(calls, s.select("qname")).join(by_name, F.col("resolved") == F.col("qname")).select(F.col("caller").alias("src"), "dst").filter("src <> dst")
    edges = cut(edges, "edges")
    tests = s.filter(F.col("path").rlike("(^|/)tests?/|(^|/)test_")).select("node")
    score = graph.pagerank(s.select("node"), edges, boosted=tests)
    return CodePack(kept, cut(s.join(score, "node", "left"), "ranked"), edges, files.select("path").join(kept.select("path"), "path", "left_anti"))
