"""Source trees: exclusion rules, symbols and calls of Python files, exports and imports of TypeScript files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators.guard import classify_symbol

SYMBOLS = "path string, qname string, kind string, line int, signature string, doc string, decorators array<string>, bases array<string>, end int"
CALLS = "path string, caller string, callee string, line int"
SKIPPED = ("*/.git/*", "*/node_modules/*", "*/__pycache__/*", "*/dist/*", "*/build/*", "*/.venv/*", "*.min.js", "*.d.ts")
GENERATED = "(?i)(@generated|do not edit|auto-?generated)"


def scan(files: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """(path, text) rows of source files outside excluded folders, without a generated mark in the first 200 characters."""
    f = files.filter(F.col("path").rlike("\\.(py|tsx|ts)$"))
    for p in (*SKIPPED, *ignore):
        f = f.filter(~F.concat(F.lit("/"), "path").rlike(T.glob_regex(p if p.startswith(("*", "/")) else f"*/{p.rstrip('/')}*")))
    return f.filter(~F.substring("text", 1, 200).rlike(GENERATED))


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.scope, self.symbols, self.calls, self.seen = path, [], [], [], {}

    def name(self, own: str) -> str:
        base = ".".join([*self.scope, own])
        k = self.seen[base] = self.seen.get(base, -1) + 1
        return base if not k else f"{base}#{k}"

    def _def(self, node, kind: str, signature: str):
        q = self.name(node.name)
        self.symbols.append((self.path, q, kind, node.lineno, signature, ast.get_docstring(node) or "", [ast.unparse(d) for d in node.decorator_list], [ast.unparse(b) for b in getattr(node, "bases", [])], node.end_lineno))
        self.scope.append(node.name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, node, word="def"):
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        self._def(node, "method" if self.scope and self.symbols and any(s[1] == ".".join(self.scope) and s[2] == "class" for s in self.symbols) else "function", f"{word} {node.name}({ast.unparse(node.args)}){back}")

    def visit_AsyncFunctionDef(self, node):
        self.visit_FunctionDef(node, "async def")

    def visit_ClassDef(self, node):
        self._def(node, "class", f"class {node.name}" + (f"({', '.join(ast.unparse(b) for b in node.bases)})" if node.bases else ""))

    def visit_Assign(self, node):
        if not self.scope:
            self.symbols += [(self.path, self.name(t.id), "const", node.lineno, ast.unparse(node)[:120], "", [], [], node.end_lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
        self.generic_visit(node)

    def visit_Import(self, node):
        self.symbols += [(self.path, a.name, "import", node.lineno, ast.unparse(node), "", [], [], node.end_lineno) for a in node.names]

    def visit_ImportFrom(self, node):
        self.symbols.append((self.path, "." * node.level + (node.module or ""), "import", node.lineno, ast.unparse(node), "", [], [], node.end_lineno))

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.calls.append((self.path, ".".join(self.scope) or "<module>", ast.unparse(node.func), node.lineno))
        self.generic_visit(node)


def _walk(path: str, text: str) -> _Walk:
    w = _Walk(path)
    try:
        w.visit(ast.parse(text or ""))
    except (SyntaxError, ValueError, RecursionError) as e:
        w.symbols.append((path, "<file>", "warning", getattr(e, "lineno", None) or 0, type(e).__name__, "", [], [], 0))
    return w


def _run(files: DataFrame, which: str, shape: str) -> DataFrame:
    cols = [c.split()[0] for c in shape.split(", ")]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.text) for r in getattr(_walk(p, t), which)], columns=cols)

    return files.filter("path LIKE '%.py'").select("path", "text").mapInPandas(f, shape)


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions, methods, constants and imports; one warning row for a file that does not parse."""
    return _run(files, "symbols", SYMBOLS)


def python_calls(files: DataFrame) -> DataFrame:
    return _run(files, "calls", CALLS)


def routes(symbols: DataFrame) -> DataFrame:
    """(path, qname, method, route): decorators such as ``app.get("/x")``."""
    d = symbols.select("path", "qname", F.explode("decorators").alias("d"))
    m = F.regexp_extract("d", "\\.(get|post|put|patch|delete|head|options)\\(", 1)
    return d.filter(m != "").select("path", "qname", F.upper(m).alias("method"), F.regexp_extract("d", "\\(['\"]([^'\"]*)['\"]", 1).alias("route"))


def models(symbols: DataFrame) -> DataFrame:
    """Classes with a model base."""
    return symbols.filter((F.col("kind") == "class") & F.exists("bases", lambda b: b.rlike("(^|\\.)(BaseModel|Base|Model|DeclarativeBase)$"))).select("path", "qname")


def typescript_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind) of top-level declarations. Regular expressions in the JVM; a body reaches to the next declaration."""
    f = files.filter(F.col("path").rlike("\\.tsx?$"))
    head = "(?:export\\s+)?(?:default\\s+)?(?:declare\\s+)?(?:abstract\\s+)?(?:async\\s+)?(?:function|const|class|interface|type|enum)\\b"
    body = F.explode(F.split("text", f"(?m)(?=^{head})")).alias("body")
    e = f.select("path", body)
    e = e.select("path", "body", *[F.regexp_extract("body", f"^{head.replace('(?:function', '(function')}\\s*\\*?\\s*([A-Za-z_$][\\w$]*)", k).alias(c) for k, c in ((1, "w"), (2, "name"))]).filter("name <> ''")
    fn = (F.col("w") == "function") | ((F.col("w") == "const") & F.col("body").rlike("^[^\\n=]*=\\s*(?:async\\s*)?(?:function\\b|\\([^=]*=>|[A-Za-z_$][\\w$]*\\s*=>|\\()"))
    renders = F.col("body").rlike("(?:^|[\\s(?:&|>])<(?:[A-Za-z][\\w.]*[\\s/>]|>)") | ((F.col("w") == "const") & F.col("body").rlike("=\\s*(?:React\\.)?(?:forwardRef|memo)\\b"))
    return e.select("path", "name", classify_symbol(F.col("name"), fn, renders, F.col("w")).alias("kind"))


def typescript_imports(files: DataFrame) -> DataFrame:
    f = files.filter(F.col("path").rlike("\\.tsx?$"))
    return f.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?m)^import\\s[^'\"]*['\"]([^'\"]+)['\"]"), 1))).alias("module"))
