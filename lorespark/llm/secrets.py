"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions only near hits, embedded checksums.

One automaton holds the keywords of all rules; a text is read once for any number of rules. Only where a keyword ends
is the rule's expression tried, anchored at that place, so texts without a keyword cost nothing more. Rules whose
tokens carry a checksum verify it; a wrong checksum is reported as such and is not a finding at the default level.

Cases: null and empty texts have no findings. Texts of any length are scanned whole. Repeated rows give their findings
once per row. Ids must be integers or cast to them. Tokens of unbounded length begin where no character of theirs stands
before, so that a text of keywords alone is read once, too. Overlapping findings of different rules are all returned; one rule reports a place once. Rows without an
id are scanned and keep a null id. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from lorespark.llm.common import id_text

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B32 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}


def crc32_base62(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits, as token issuers append it."""
    n, out = binascii.crc32(body.encode()) & 0xFFFFFFFF, ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _crc_tail(token: str) -> bool:
    """The last six characters are the checksum of the part between the prefix and them."""
    body = token.split("_")[-1]
    return crc32_base62(body[:-6]) == body[-6:]


def _aws_key(token: str) -> bool:
    """The account that the base-32 digits name has twelve decimal digits; ids of the older series (I and J) name none."""
    if token[4] in "IJ":
        return True
    n = 0
    for c in token[4:14]:
        if c not in _B32:
            return False
        n = n * 32 + _B32[c]
    return 0 < (n >> 2 & 0x7FFFFFFFFF80) >> 7 < 10**12


def _jwt(token: str) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    import base64
    import json

    try:
        head = token.split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s))) if n else 0.0


def _random(token: str) -> bool:
    return entropy(token) >= 3.0


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is matched where a keyword begins; its group ``s`` is the secret. ``check`` is the validation."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    check: str = ""


CHECKS = {"crc32": _crc_tail, "aws": _aws_key, "jwt": _jwt, "entropy": _random}

RULES = (
    SecretRule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?P<s>gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])", "crc32"),
    SecretRule("npm_token", ("npm_",), r"(?P<s>npm_[0-9A-Za-z]{36})(?![0-9A-Za-z])", "crc32"),
    SecretRule("aws_key_id", ("AKIA", "ASIA"), r"(?P<s>A[KS]IA[A-Z2-7]{16})(?![0-9A-Za-z])", "aws"),
    SecretRule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), r"(?<![0-9A-Za-z-])(?P<s>xox[bpar]-[0-9A-Za-z-]{20,})"),
    SecretRule("stripe_key", ("sk_live_", "rk_live_"), r"(?P<s>[sr]k_live_[0-9A-Za-z]{16,})"),
    SecretRule("google_key", ("AIza",), r"(?P<s>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"),
    SecretRule("jwt", ("eyJ",), r"(?<![0-9A-Za-z_-])(?P<s>eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,})", "jwt"),
    SecretRule("private_key", ("-----begin",), r"(?P<s>-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"),
    SecretRule(
        "assignment",
        ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth_key"),
        r"(?i:token|secret|password|passwd|api_?key|access_key|private_key|auth_key)[\"']?\s{0,3}[:=]\s{0,3}[\"'](?P<s>[0-9A-Za-z+/=_.\-]{16,128})[\"']",
        "entropy",
    ),
)
#: What a caller drops or masks: checks that passed, and rules that have none.
SCHEMA = "doc_id long, rule string, start int, length int, secret string, verified boolean"


class Scanner:
    """Automaton and expressions, built once per Python worker."""

    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                by_word.setdefault(k.lower(), []).append(i)
        for k, where in by_word.items():
            self.auto.add_word(k, (len(k), tuple(where)))
        self.auto.make_automaton()
        self.rules = [(r.name, re.compile(r.pattern), CHECKS.get(r.check)) for r in rules]

    def scan(self, text: str) -> list[tuple[str, int, int, str, bool]]:
        """(rule, start, length, secret, verified), by place."""
        if not text:
            return []
        folded = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
        out = {}
        for end, (k, where) in self.auto.iter(folded):
            at = end - k + 1
            for i in where:
                name, rx, check = self.rules[i]
                m = rx.match(text, at)
                if m:
                    s = m.group("s")
                    out[name, m.start("s")] = (name, m.start("s"), len(s), s, check(s) if check else True)
        return sorted(out.values(), key=lambda x: (x[1], x[0]))


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All findings of all documents, ``start`` in characters; ``verified`` is false where a checksum is wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(rules)
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b["doc_id"], b["text"]) for hit in s.scan(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "rule", "start", "length", "secret", "verified"])
            yield out.astype({"doc_id": "Int64", "start": "int32", "length": "int32", "verified": "bool"})

    return id_text(docs, id_col, text_col).mapInPandas(run, SCHEMA)


def oracle() -> str:
    """SQL of the rules that need no checksum other than entropy, for tables in which only assignments occur."""
    return r"""
WITH h AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i:token|secret|password|passwd|api_?key|access_key|private_key|auth_key)["'']?\s{0,3}[:=]\s{0,3}["''][0-9A-Za-z+/=_.\-]{16,128}["'']')) AS hit FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, hit) AS k FROM h),
p AS (SELECT doc_id, text, hit, k, regexp_extract(hit, '["'']([0-9A-Za-z+/=_.\-]{16,128})["'']$', 1) AS secret,
  length(list_reduce(list_concat([''], list_transform(range(1, k + 1), lambda i: string_split(text, hit)[i] || hit)), lambda a, b: a || b)) AS stop FROM o)
SELECT doc_id, 'assignment' AS rule, CAST(stop - 1 - length(secret) AS INTEGER) AS start, CAST(length(secret) AS INTEGER) AS length, secret,
  list_sum(list_transform(list_distinct(string_split_regex(secret, '')), lambda c: -(length(secret) - length(replace(secret, c, '')))::DOUBLE / length(secret) * log2((length(secret) - length(replace(secret, c, '')))::DOUBLE / length(secret)))) >= 3.0 AS verified FROM p"""
