"""Scalar text functions as Catalyst expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILLERS = (
    "a all also an and any are as at be been being but by can could did do does during each every for from had has have in into is it its just may might no not of on or"
    " shall should so some that the then these this those through to very was were will with would"
).split()

#: In this order: longer signs before their parts.
ASCII_FORMS = (("§CTX", "$CTX"), ("⊥", "CONFLICT:"), ("≡", "==="), ("⚠", "WARN:"), ("★", "***"), ("¬", "!"), ("→", "->"), ("±", "##"), ("§", "$CTX"))


def query_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of two characters or more; cut out first, then lower-cased."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit("([a-zA-Z0-9]+)"), 1), lambda t: F.length(t) > 1), F.lower)


def identifier_tokens(text: Column) -> Column:
    """Identifiers, lower-cased, each followed by its CamelCase and snake_case parts that differ from it."""
    parts = lambda w: F.filter(F.transform(F.regexp_extract_all(w, F.lit("([A-Z][a-z]+|[A-Z]+(?=[A-Z]|$)|[a-z]+|[0-9]+)"), 1), F.lower), lambda p: p != F.lower(w))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.concat(F.array(F.lower(w)), parts(w))))


def words(text: Column) -> Column:
    """White-space words; none in an empty text."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def canonical_name(name: Column) -> Column:
    """Upper case, blanks and underscores as hyphens, without the entity prefix."""
    return F.regexp_replace(F.translate(F.upper(F.trim(name)), "_ ", "--"), "^ENTITY-", "")


def without_fillers(text: Column) -> Column:
    """Drops filler words; a text of fillers alone stays as it is."""
    kept = F.filter(words(text), lambda w: ~F.regexp_replace(F.lower(w), "[.,;:!?]+$", "").isin(FILLERS))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), text)


def ascii_form(text: Column) -> Column:
    for a, b in ASCII_FORMS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def search_key(text: Column) -> Column:
    """Sorted distinct lower-case words: equal for reordered queries."""
    return F.array_join(F.array_sort(F.array_distinct(words(F.lower(text)))), " ")


_KEPT = "@[\\p{L}\\p{N}_-]+|[0-9]+-[0-9]+|[A-Z][A-Z0-9_]+-[A-Z][A-Z0-9_]+"


def dehyphenated(value: Column) -> Column:
    """Hyphens become blanks, runs of blanks one; references, ranges of numbers and hyphenated capitals keep theirs, also inside longer words."""
    parts = F.regexp_extract_all(value, F.lit(f"(?s)({_KEPT}|.)"), 1)
    return F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.when(p == "-", " ").otherwise(p)), ""), "  +", " ")


def abbreviated(value: Column) -> Column:
    """The first clause before |, then before an arrow, then before a comma; otherwise 37 characters of a value of over 40."""
    first = lambda sep: F.concat(F.trim(F.substring_index(value, sep, 1)), F.lit("…"))
    long = F.when(F.length(value) > 40, F.concat(F.substring(value, 1, 37), F.lit("…"))).otherwise(value)
    return F.when(value.contains("|"), first("|")).when(value.contains("→"), first("→")).when(value.contains(","), first(",")).otherwise(long)


def months(value: Column) -> Column:
    """Months of a retention text, years counted twelvefold; null where there are none."""
    m = F.regexp_extract(value, "(?i)([0-9]+)[-\\s]*months?", 1)
    y = F.regexp_extract(value, "(?i)([0-9]+)[-\\s]*years?", 1)
    return F.when(m != "", m.cast("int")).when(y != "", y.cast("int") * 12)


def any_of(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored expression for a shell pattern; * and ? also match slashes."""
    import fnmatch

    return "^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z") + "$"


OPERATORS = (
    ("CONFLICT:", "conflict"), ("WARN:", "warning"), ("$CTX", "magic"), ("===", "equivalence"), ("***", "emphasis"), ("##", "section"), ("->", "arrow"), (">>", "sequence"), ("~>", "weak_assoc"), ("§", "magic"), ("±", "section"),
    ("¬", "negation"), ("→", "arrow"), ("≡", "equivalence"), ("⊥", "conflict"), ("⚠", "warning"), ("★", "emphasis"), ("!", "negation"), ("+", "conjunction"), ("?", "uncertainty"), ("@", "cross_ref"), ("|", "disjunction"), ("~", "approx"),
)


def operators(text: Column) -> Column:
    """Kinds of the signs of a text in order; what stands between backticks, and all after an unpaired one, is skipped. Longer signs go first."""
    import re

    signs = "|".join(re.escape(s).replace("\\#", "#") for s, _ in OPERATORS)
    found = F.regexp_extract_all(text, F.lit(f"(?s)(`[^`]*`|`.*|{signs})"), 1)
    kinds = F.create_map(*[F.lit(x) for s in OPERATORS for x in s])
    return F.filter(F.transform(found, lambda s: F.element_at(kinds, s)), lambda k: k.isNotNull())


SEMANTIC = "active|approved|archived|cascade|confidential|churn|deleted|encrypted?|gdpr|immutable|inactive|mandatory|nullable|pci[-_]?dss|pending|pii|required|restricted|retention|unique"


def semantic_keywords(text: Column) -> Column:
    """Sorted distinct terms of the domain in a text, lower-cased."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)\\b({SEMANTIC})\\b"), 1), F.lower)))


def catalogue_size(text: Column) -> Column:
    """How many things a catalogue lists: its headings, else its bracketed sections, else its numbered items."""
    n = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), 0))
    head, section, item = n("(?m)^#{1,6}\\s+\\S"), n("(?m)^\\[[\\w-]+\\]"), n("(?m)^\\d+\\.\\s+\\S")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).when(head > 0, head).when(section > 0, section).otherwise(item)


def truncated(text: Column, cap: int) -> Column:
    """The longest beginning of at most ``cap`` estimated tokens, with a marker of how much is left out."""
    fits = F.lit(4 * cap + 3)
    return F.when(estimated_tokens(text) <= cap, text).otherwise(F.concat(F.substring(text, F.lit(1), fits), F.lit("\n[truncated "), (F.length(text) - fits).cast("string"), F.lit(" characters to fit]")))


def catalogue_row(name: Column, kind: Column, signature: Column, about: Column, cap: int) -> Column:
    """``name | kind | signature | about``; a signature beyond the cap ends after the last boundary of its last 12 characters, if there is one."""
    row = lambda s: F.concat_ws(" | ", name, kind, F.nullif(s, F.lit("")), F.nullif(about, F.lit("")))
    room = F.greatest(F.lit(0), F.lit(4 * cap + 3) - F.length(row(F.lit("x"))) + 1 - 1)
    head = F.rtrim(F.regexp_replace(F.substring(signature, F.lit(1), room), "(?s)([\\s,(\\[{|:;]).{0,11}$", "$1"))
    return F.when(estimated_tokens(row(signature)) <= cap, row(signature)).otherwise(row(F.concat(head, F.lit("…"))))
