"""Evaluation: grades by group, compression, latency, cost, gates, pivots, paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T

RATES = {
    "o4-mini": 0.0011, "gpt-5.2": 0.005, "gpt-4o-mini": 0.00015, "gpt-4o": 0.0025, "gemini-2.5-pro": 0.00125, "gemini-2.5-flash-lite": 0.0, "gemini-2.5-flash": 0.00015,
    "claude-sonnet-4-6": 0.003, "claude-sonnet-4-5-20250929": 0.003, "claude-sonnet-4-20250514": 0.003, "claude-opus-4-6": 0.015, "claude-haiku-4-5-20251001": 0.001, "claude-haiku-4-5": 0.001,
}  # dollars for a thousand input tokens
NOT_THERE = (
    "cannot be determined", "does not contain", "does not mention", "does not specify", "doesn't contain", "doesn't mention", "doesn't specify", "no explicit", "no information", "not addressed",
    "not available", "not covered", "not explicitly", "not found in context", "not in the context", "not included", "not mentioned", "not provided", "not specified",
)
DEFAULT_RATE = 0.003


def grades(results: DataFrame, by: str) -> DataFrame:
    """Totals by group and over all (group null) in one pass: total, correct, score, precision and recall of (expected, predicted)."""
    ok = F.col("expected") == F.col("predicted")
    hit = F.count_if(F.col("expected") & F.col("predicted")).cast("double")
    return results.groupingSets([[by], []], by).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.round(F.count_if(ok) / F.count("*"), 9).alias("score"),
        F.round(hit / F.nullif(F.count_if("predicted"), F.lit(0)), 9).alias("precision"), F.round(hit / F.nullif(F.count_if("expected"), F.lit(0)), 9).alias("recall"),
    )


def compression(texts: DataFrame, by: str, source: Column, compressed: Column) -> DataFrame:
    """Words and estimated tokens before and after, and the ratio of words (0 where nothing is left). Each text is read once: the generator keeps what it measured."""
    sides = F.array(F.struct(source.alias("s"), compressed.alias("c")))
    measure = lambda x: F.struct(*[f(x[c]).alias(n) for n, f, c in (("source_words", T.word_count, "s"), ("words", T.word_count, "c"), ("source_tokens", T.estimated_tokens, "s"), ("tokens", T.estimated_tokens, "c"))])
    g = texts.select(by, F.inline(F.transform(sides, measure))).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("source_words", "words", "source_tokens", "tokens")])
    return g.withColumn("ratio", F.when(F.col("words") == 0, 0.0).otherwise(F.round(F.col("source_words") / F.nullif("words", F.lit(0)), 6)))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and exact percentiles with linear interpolation."""
    p = [F.round(F.percentile(value, q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return rows.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), *p)


def token_cost(rows: DataFrame, tokens: str, model: str, rates: dict[str, float] = RATES) -> DataFrame:
    """Adds ``cost``: tokens by the thousand at the model's rate, or at the default one."""
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col(model)) if rates else F.lit(None), F.lit(DEFAULT_RATE))
    return rows.withColumn("cost", F.col(tokens) / 1000 * rate)


def gates(metrics: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, passed) for each rule: column -> (<= or >=, threshold)."""
    rows = [F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.coalesce(F.col(c) <= t if op == "<=" else F.col(c) >= t, F.lit(False)).alias("passed")) for c, (op, t) in rules.items()]
    return metrics.select(F.inline(F.array(*rows)))


def correctness_pivot(results: DataFrame, question: str, run: str, runs: list[str]) -> DataFrame:
    """A row for each question and a column for each run; a missing result is false. The runs are named, so no job looks for them."""
    p = results.groupBy(question).pivot(run, runs).agg(F.bool_or("correct"))
    return p.select(question, *[F.coalesce(F.col(f"`{r}`"), F.lit(False)).alias(r) for r in runs])


def flips(a: DataFrame, b: DataFrame, question: str, by: str) -> DataFrame:
    """By group: how often both pass, both fail, only a or only b passes, and the mean answer lengths."""
    j = a.select(question, by, F.col("correct").alias("ca"), F.col("answer_len").alias("la")).join(b.select(question, F.col("correct").alias("cb"), F.col("answer_len").alias("lb")), question)
    n = lambda c: F.count_if(c)
    return j.groupBy(by).agg(n(F.col("ca") & F.col("cb")).alias("both_pass"), n(~F.col("ca") & ~F.col("cb")).alias("both_fail"), n(F.col("ca") & ~F.col("cb")).alias("a_wins"), n(~F.col("ca") & F.col("cb")).alias("b_wins"), F.round(F.avg("la"), 6).alias("len_a"), F.round(F.avg("lb"), 6).alias("len_b"))


def answer_matches(answer: Column, expected: Column, share: float = 0.6) -> Column:
    """Whether an answer holds what is expected: the whole of it, or the share of its words of three letters or more, each inside the
    answer or, from three letters on, the beginning of one of its words or the other way round. NOT_IN_CONTEXT expects a phrase that says so."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]", " "), " +", " "))
    graded = F.transform(F.array(F.struct(norm(answer).alias("a"), norm(expected).alias("e"))), lambda s: _graded(s["a"], s["e"], share))[0]  # each side is normalised once
    return F.when((F.coalesce(answer, F.lit("")) == "") | (F.coalesce(expected, F.lit("")) == ""), F.lit(False)).when(expected == "NOT_IN_CONTEXT", T.any_of(F.lower(answer), NOT_THERE)).otherwise(graded)


def _graded(a: Column, e: Column, share: float) -> Column:
    want = F.filter(F.split(e, " "), lambda w: F.length(w) > 2)
    begins = lambda t: F.exists(F.split(a, " "), lambda w: (F.length(w) >= 3) & (w.startswith(t) | t.startswith(w)))
    hits = F.size(F.filter(want, lambda t: a.contains(t) | begins(t)))
    return a.contains(e) | ((F.size(want) > 0) & (hits / F.greatest(F.size(want), F.lit(1)) >= share))


def content_version(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """One SHA-256 of all rows: digests of the rows, in order, then the digest of their list by groups of leading hex digits.

    The grouping keeps the work distributed: one driver-sized string is never built from the texts themselves.
    """
    d = rows.select(F.sha2(F.concat_ws("\x1f", *order, value), 256).alias("d")).withColumn("g", F.substring("d", 1, 2))
    g = d.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("h"))
    return g.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("version"))


def rollup_paths(modules: DataFrame, path: str, depth: int) -> DataFrame:
    """Counts by the first ``depth`` folders."""
    folder = F.array_join(F.slice(F.split(F.col(path), "/"), 1, depth), "/")
    return modules.groupBy(folder.alias("folder")).agg(F.count("*").alias("modules"), F.sum("functions").alias("functions"), F.sum("classes").alias("classes"))


def directory(rows: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind by group, with a total row (group null)."""
    return rows.rollup(by).agg(*[F.count_if(F.col(kind) == k).alias(k.lower()) for k in kinds], F.count("*").alias("all"))
