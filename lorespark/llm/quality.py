"""Quality rules: a threshold table compiled into one projection of built-in expressions, without user functions.

Cases: null text counts as empty; an empty or blank text has no words and fails ``min_words``; ratios of an empty text
are 0. Very long texts are scored whole. Repeated rows are scored one by one and all kept or all rejected. An empty
table stays empty. Extra columns, whatever their names, pass through :func:`keep_good`; :func:`score` returns only the
id and its own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the of and to in is that it was for on are as with be by at from this have or an a not "
    "le la les de des et un une en que qui dans pour par sur au du est pas avec ce il "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las y se del por con para su al lo como más o pero sus no"
).split()
SYMBOLS = "#$%&*|~^<>{}[]=+_\\!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÇÈÉÊËÎÏÔÙÛÄÖÜÑÁÍÓÚ"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] (None: open) in a text of at least ``from_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Production thresholds. Ratios are over characters, words or lines of the whole text.
RULES = (
    Rule("min_words", "n_words", low=1),
    Rule("mean_word_length", "mean_word_len", low=1.5, high=20, from_words=5),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("capitals", "capital_ratio", high=0.4, from_words=3),
    Rule("adjacent_repeats", "repeat_ratio", high=0.2, from_words=5),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=60),
    Rule("repeated_lines", "distinct_line_ratio", low=0.4),
)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct of all metrics and ``failed`` (the names of the failed rules, joined by commas).

    Words are split by white space, lines by line feeds. The text is split once: the one-element ``transform`` binds the
    pieces to a lambda variable, which no optimiser rule copies into several places.
    """
    t = F.coalesce(text, F.lit(""))
    per = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    pieces = F.struct(t.alias("t"), F.filter(F.split(t, "\\s+"), lambda w: w != "").alias("w"), F.split(t, "\n").alias("l"))

    def measure(s: Column) -> Column:
        t, words, lines = s["t"], s["w"], s["l"]
        n_chars, n_words = F.length(t), F.size(words)
        without = lambda chars: F.length(F.translate(t, chars, ""))
        tail = F.greatest(n_words - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, 1, tail), F.slice(words, 2, tail), lambda a, b: a == b)
        return F.struct(
            n_chars.cast("long").alias("n_chars"),
            n_words.cast("long").alias("n_words"),
            per(n_chars, n_words).alias("mean_word_len"),
            per(n_chars - without(SYMBOLS), n_chars).alias("symbol_ratio"),
            per(n_chars - without(CAPITALS), n_chars).alias("capital_ratio"),
            per(F.size(F.filter(pairs, lambda x: x)), n_words).alias("repeat_ratio"),
            per(F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))), n_words).alias("stop_ratio"),
            per(F.size(F.array_distinct(lines)), F.size(lines)).alias("distinct_line_ratio"),
        )

    def judge(m: Column) -> Column:
        failed = []
        for r in rules:
            bad = F.lit(False)
            if r.low is not None:
                bad = bad | (m[r.metric] < r.low)
            if r.high is not None:
                bad = bad | (m[r.metric] > r.high)
            failed.append(F.when((m["n_words"] >= r.from_words) & bad, F.lit(r.name)))
        return F.struct(*[m[k].alias(k) for k in METRICS], F.concat_ws(",", *failed).alias("failed"))

    return F.transform(F.transform(F.array(pieces), measure), judge)[0]


METRICS = ("n_chars", "n_words", "mean_word_len", "symbol_ratio", "capital_ratio", "repeat_ratio", "stop_ratio", "distinct_line_ratio")


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, each metric (ratios rounded to 6 decimals), the failed rules and ``keep``."""
    v = docs.select(F.col(f"`{id_col}`").alias("doc_id"), verdict(F.col(f"`{text_col}`"), rules).alias("v"))
    shown = [v["v"][k].alias(k) if k.startswith("n_") else F.round(v["v"][k], 6).alias(k) for k in METRICS]
    return v.select("doc_id", *shown, v["v"]["failed"].alias("failed"), (v["v"]["failed"] == "").alias("keep"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that fail no rule, with all their columns."""
    return docs.filter(verdict(F.col(f"`{text_col}`"), rules)["failed"] == "")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The projection in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    stops = ", ".join(map(q, STOP_WORDS))
    fail = []
    for r in rules:
        tests = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        fail.append(f"CASE WHEN n_words >= {r.from_words} AND ({' OR '.join(tests)}) THEN '{r.name}' END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
m AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
  CASE WHEN len(ws) > 0 THEN length(t)::DOUBLE / len(ws) ELSE 0 END AS mean_word_len,
  CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, {q(SYMBOLS)}, '')))::DOUBLE / length(t) ELSE 0 END AS symbol_ratio,
  CASE WHEN length(t) > 0 THEN (length(t) - length(translate(t, {q(CAPITALS)}, '')))::DOUBLE / length(t) ELSE 0 END AS capital_ratio,
  CASE WHEN len(ws) > 0 THEN len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::DOUBLE / len(ws) ELSE 0 END AS repeat_ratio,
  CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda x: x IN ({stops})))::DOUBLE / len(ws) ELSE 0 END AS stop_ratio,
  CASE WHEN len(ls) > 0 THEN len(list_distinct(ls))::DOUBLE / len(ls) ELSE 0 END AS distinct_line_ratio FROM w),
f AS (SELECT *, concat_ws(',', {', '.join(fail)}) AS failed FROM m)
SELECT doc_id, n_chars, n_words, round(mean_word_len, 6) AS mean_word_len, round(symbol_ratio, 6) AS symbol_ratio, round(capital_ratio, 6) AS capital_ratio,
  round(repeat_ratio, 6) AS repeat_ratio, round(stop_ratio, 6) AS stop_ratio, round(distinct_line_ratio, 6) AS distinct_line_ratio, failed, failed = '' AS keep FROM f"""
