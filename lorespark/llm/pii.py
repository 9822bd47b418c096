"""PII: candidate gradient boosting. Generators propose overlapping spans, boosted trees score them, calibrated thresholds select redactions.

Generators favour recall: every run of text that might be an address, a number of a person or of a machine is proposed,
also when runs overlap: of a row of digit groups all ranges that a phone number could fill. A candidate has features of its
format (lengths, groups, checksums, octets) and of its context (neighbouring characters, key words before and after it).
Gradient-boosted trees, fitted here on a seeded set of labelled examples of ``TRAINING_ROWS`` rows, score all candidates of a
batch at once; per kind, isotonic calibration on held-out examples gives the least score whose spans are right with
probability ``PRECISION``. Of overlapping selected spans the likeliest stays.

Generators take time in proportion to the text: all repetitions are bounded, and addresses are sought from their @. Each
names what its candidates cannot lack; texts that lack all of that never leave the JVM.

The trees depend on no table, so every document is judged alike at every size.

Cases: null and empty texts have no spans; null stays null when redacted. Texts of any length are scanned whole.
Repeated rows and null ids are handled row by row; ids must be integers or cast to them. Equal scores: the longer span,
then the earlier one. Extra columns pass through :func:`redact`. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import id_text
from lorespark.llm.secrets import entropy, luhn

TRAINING_ROWS = 10_000
PRECISION = 0.9
TREES, DEPTH, RATE, LEAST = 60, 4, 0.2, 20

#: kind, expression, and what each of its matches contains, as an expression of Python and of Spark alike
GENERATORS = (
    ("email", re.compile(r"@(?:[\w-]{1,63}\.){1,8}[\w-]{1,63}"), "@"),  # the part before the @ is taken from there
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-])?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,8}(?:[ ./-][0-9]{2,8}){1,6}(?!\w)|\+[0-9]{8,15}(?![0-9])|\([0-9]{2,5}\) ?[0-9]{3,8}(?:[ -][0-9]{2,6}){0,3}(?!\w)"), "[0-9]"),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"), "[0-9]"),
    ("card", re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])"), "[0-9]"),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"), "[0-9]"),
    ("ip", re.compile(r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![\w:])"), "[0-9]|[a-fA-F]:[a-fA-F]"),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?(?![\w:])"), "::"),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), "[0-9]"),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)"), "[0-9]"),
)
HAS_CANDIDATE = "|".join(dict.fromkeys(g[2] for g in GENERATORS))
_LOCAL = re.compile(r"[\w.+%-]{1,64}\Z")
_GROUP = re.compile(r"[+(]{0,2}[0-9]+\)?")
KINDS = tuple(dict.fromkeys(k for k, *_ in GENERATORS))
_CUES = {
    "email": ("mail", "contact", "write", "e-mail", "courriel", "correo"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "appel"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "account", "payment"),
    "ip": ("ip", "host", "address", "server", "client", "login"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
_AGAINST = ("version", "isbn", "order", "token", "serial", "ref", "build", "release", "section", "figure", "page", "license", "rfc", "sku", "part", "chapter", "commit", "=")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every proposal of every generator."""
    found = set()
    for kind, rx, _ in GENERATORS:
        k = KINDS.index(kind)
        for m in rx.finditer(text):
            start, end = m.span()
            if kind == "email":
                before = _LOCAL.search(text, max(0, start - 64), start)
                if before:
                    found.add((k, before.start(), end))
            elif end > start:
                found.add((k, start, end))
                if kind == "phone":
                    groups = [(g.start(), g.end(), sum(c.isdigit() for c in g[0])) for g in _GROUP.finditer(text, start, end)]
                    for i in range(len(groups)):
                        n = 0
                        for _, stop, size in groups[i:]:
                            n += size
                            if 7 <= n <= 15:
                                found.add((k, groups[i][0], stop))
    return sorted(found)


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate; the context is 40 characters on either side."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"\d+", s)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 2]
    words, later = re.findall(r"[^\W\d_]+|=", before)[-4:], re.findall(r"[^\W\d_]+", text[end : end + 40].lower())[:4]
    octets = [int(g) for g in groups] if kind == 3 and ":" not in s else []
    name = KINDS[kind]
    return [
        float(kind), float(len(s)), float(len(digits)), len(digits) / len(s), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(luhn(digits)) if 12 <= len(digits) <= 19 else -1.0, float(all(0 <= o <= 255 for o in octets)) if octets else -1.0, float(octets[0]) if octets else -1.0,
        float(s.startswith("+")), float("(" in s), float(" " in s), float("-" in s), float("." in s), float(digits[:1] == "0"), float(len(set(digits))), entropy(s),
        float(_iban(s)) if kind == 5 else -1.0, float(len(s.rsplit(".", 1)[-1])) if kind == 0 else -1.0, float(s.split("@")[0][:1].isalnum()) if kind == 0 else -1.0,
        float(any(c in w for w in words for c in _CUES[name])), float(any(w in _AGAINST for w in words[-1:])), float(before[-1:] in ('"', "'")), float(before[-1:] in ("", " ", "\n", "(", ",", ":", "<")),
        float(after[:1] in ("", " ", "\n", ",", ".", ")", ";", "!", "?", ">")), float(after[:1].isalnum() or after[:1] == "_"), float(after[:1] == "." and after[1:2].isdigit()), float("/" in before[-8:]),
        float(any(w in _AGAINST for w in later)), float(before[-2:-1].isdigit() and before[-1:] in " .-/" or before[-1:].isdigit()), float(after[:1] in (" ", ".", "-", "/") and after[1:2].isdigit()), float(s.count(":")), float("::" in s), float(max(map(len, re.split("[:]+", s)))),
    ]


# ----- labelled examples
def _word(r: random.Random) -> str:
    if r.random() < 0.4:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10)))
    return "".join(r.choice(("an", "er", "th", "en", "re", "on", "ti", "st", "le", "do", "ch", "ver", "ga", "ó", "é")) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn_card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, 14)
    return next(body + c for c in "0123456789" if luhn(body + c))


def _real_iban(r: random.Random) -> str:
    body = _digits(r, 18)
    check = 98 - int(body + "131400") % 97  # DE
    return f"DE{check:02d}{body}"


def _positive(r: random.Random) -> tuple[str, str]:
    kind = r.choice(KINDS)
    if kind == "email":
        s = f"{_word(r)}{r.choice(('', '.', '_', '+'))}{r.choice((_word(r), _digits(r, 2)))}@{_word(r)}{r.choice(('', _digits(r, 1)))}.{r.choice(('example.com', 'org', 'co.uk', 'net', 'de'))}"
        s = (s.encode("ascii", "ignore").decode() or "a@b.de").lstrip(".+_")
        s = s if re.match(r"[\w.+]+@[\w]", s) else "a1@mail.example.com"
        return kind, s.upper() if r.random() < 0.1 else s
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return kind, r.choice((f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"+49 {a} {b}{c[:1]} {c}", f"+33 {_digits(r, 1)}{a[:1]} {b[:2]} {c[:2]} {a[:2]} {c[2:]}", f"{a}-{b}-{c}", f"+44{a}{b}{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"+91 {a}{b[:2]} {b[2]}{c}", f"0{a[:2]} {c} {b}{a[2]}", f"0{a}/{b}{c}"))
    if kind == "card":
        s = _luhn_card(r) if r.random() < 0.4 else _digits(r, 16)  # cards are also written with wrong digits
        return kind, s if r.random() < 0.7 else " ".join(s[i : i + 4] for i in range(0, 16, 4)) if r.random() < 0.5 else "-".join(s[i : i + 4] for i in range(0, 16, 4))
    if kind == "ip":
        if r.random() < 0.3:
            part = lambda: f"{r.choice((r.randint(1, 20), r.randint(1, 65535))):x}"
            return kind, r.choice((":".join(part() for _ in range(8)), f"fe80::{part()}", f"2001:db8::{part()}:{part()}", f"{part()}:{part()}::{part()}", f"::ffff:{part()}"))
        if r.random() < 0.2:
            return kind, r.choice((f"10.{r.randint(0, 5)}.{r.randint(0, 5)}.{r.randint(1, 30)}", f"192.168.{r.randint(0, 9)}.{r.randint(1, 254)}", f"172.16.0.{r.randint(1, 99)}"))
        return kind, ".".join(str(r.randint(1 if i == 0 else 0, 255)) for i in range(4))
    if kind == "national_id":
        return kind, f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    s = _real_iban(r)
    return kind, s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _negative(r: random.Random) -> str:
    n = r.randint
    return r.choice((
        lambda: f"version {n(1, 20)}.{n(0, 30)}.{n(0, 999)}.{n(0, 9999)}", lambda: f"release {n(1, 9)}.{n(0, 20)}.{n(0, 20)}.{n(256, 999)}", lambda: f"{n(256, 999)}.{n(0, 999)}.{n(256, 999)}.{n(0, 999)}",
        lambda: f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", lambda: f"{n(1, 28):02d}.{n(1, 12):02d}.{n(1900, 2030)}", lambda: f"ISBN 978-{n(0, 9)}-{_digits(r, 4)}-{_digits(r, 4)}-{n(0, 9)}",
        lambda: f"order {_digits(r, 12)}", lambda: f"serial {_digits(r, 14)}", lambda: f"part {_digits(r, 5)} {_digits(r, 4)}", lambda: f"{n(10, 99)} {n(10, 99)}", lambda: f"pages {n(10, 400)} - {n(401, 900)}",
        lambda: f'token = "{_digits(r, n(12, 19))}{r.choice("abcdef")}{_digits(r, 8)}"', lambda: f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", lambda: f"{n(1, 99)}.{n(100, 999)}.{n(100, 999)}", lambda: f"@{_word(r)}", lambda: f"{_word(r)}@{_word(r)}",
        lambda: f"section {n(1, 20)}.{n(1, 20)}.{n(1, 20)}.{n(1, 20)}", lambda: f"{n(0, 23)}:{n(0, 59):02d}:{n(0, 59):02d}", lambda: f"build {_digits(r, 13)}", lambda: f"{_digits(r, 20)}{_digits(r, 8)}", lambda: f"RFC {_digits(r, 4)}-{_digits(r, 4)}",
        lambda: f"AB{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", lambda: f"sku {_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 4)}", lambda: f"{n(1, 9)},{_digits(r, 3)}.{_digits(r, 2)}",
        lambda: f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}.{n(0, 20)} {r.choice(('is the release', 'is the version', 'release', 'is our build'))}", lambda: ":".join(f"{n(0, 255):02x}" for _ in range(6)), lambda: "::", lambda: f"{_word(r)}::{_word(r)}", lambda: f"std::{_word(r)}", lambda: f"a::b", lambda: f"{n(1, 31)}/{n(1, 12)}/{n(1900, 2030)}",
        lambda: " ".join(_digits(r, n(1, 5)) for _ in range(n(3, 9))), lambda: f"{n(1900, 2030)} {n(1900, 2030)} {n(1900, 2030)}",
    ))()


def examples(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of every candidate in ``rows`` small texts: a candidate is right if kind and span are those planted."""
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(rows):
        text, want = " ".join(_word(r) for _ in range(r.randint(0, 5))), set()
        for _ in range(r.choice((1, 1, 2, 3))):
            text += " " if text and not text[-1].isspace() else ""
            if r.random() < 0.55:
                kind, s = _positive(r)
                if kind == "phone" and r.random() < 0.1:
                    text += f"{r.randint(1, 99)} "  # numbers beside a number
                if r.random() < 0.1:
                    text += f"{r.choice(_AGAINST)} {_word(r)} "  # such a word alone is no proof
                if r.random() < 0.35:
                    text += r.choice(_CUES[kind]) + r.choice((" ", ": "))
                want.add((KINDS.index(kind), len(text), len(text) + len(s)))
                text += s
            else:
                text += _negative(r)
            text += r.choice(("", "", "", ".", ",", "!!", "###", "%%%", " |", "\n")) + " " + " ".join(_word(r) for _ in range(r.choice((0, 1, 2, 4))))
        for c in candidates(text):
            xs.append(features(text, *c))
            ys.append(float(c in want))
    return np.array(xs), np.array(ys)


# ----- boosted trees
class Boosted:
    """Gradient-boosted regression trees for the logistic loss, complete binary trees in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST):
        self.depth = depth
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        width, most = x.shape[1], max(map(len, cuts)) + 1
        wide, used = np.arange(width), np.arange(most - 1) < np.array([len(c) for c in cuts])[:, None]
        self.feature = np.zeros((trees, (1 << depth) - 1), np.int64)
        self.cut = np.full((trees, (1 << depth) - 1), np.inf)
        self.leaf = np.zeros((trees, 1 << depth))
        score = np.full(len(y), self.base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, nodes = (1 << level) - 1, 1 << level
                at = (((node * width)[:, None] + wide) * most + bins).ravel()
                gs, hs, ns = (np.bincount(at, np.repeat(v, width), nodes * width * most).reshape(nodes, width, most) for v in (g, h, np.ones(len(y))))
                gl, hl, nl = (v.cumsum(2)[:, :, :-1] for v in (gs, hs, ns))
                ga, ha, na = (v[:, :1].sum(2, keepdims=True) for v in (gs, hs, ns))
                ok = (nl >= least) & (na - nl >= least) & used
                gain = np.where(ok, gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1), -1).reshape(nodes, -1)
                for k, i in enumerate(gain.argmax(1).tolist()):
                    f, c = divmod(i, most - 1)
                    if gain[k, i] > 1e-9:
                        self.feature[t, first + k], self.cut[t, first + k] = f, cuts[f][c]
                node = 2 * node + (x[np.arange(len(x)), self.feature[t, first + node]] > self.cut[t, first + node])
            n = 1 << depth
            self.leaf[t] = rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
            score += self.leaf[t][node]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (least score of each block, rate of right ones in it)."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[o].tolist(), y[o].tolist()):
        if blocks and blocks[-1][3] == s:
            blocks[-1][1] += v
            blocks[-1][2] += 1
        else:
            blocks.append([s, v, 1, s])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + b[1], blocks[-1][2] + b[2], b[3]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Trees, and per kind the calibration and the threshold."""

    def __init__(self, rows: int = TRAINING_ROWS, precision: float = PRECISION):
        x, y = examples(rows, 1)
        self.trees = Boosted(x, y)
        x, y = examples(rows // 3, 2)
        s = self.trees.score(x)
        self.calibration, self.threshold = [], np.full(len(KINDS), np.inf)
        for k in range(len(KINDS)):
            mine = x[:, 0] == k
            lo, p = isotonic(s[mine], y[mine])
            self.calibration.append((lo, p))
            good = np.flatnonzero(p >= precision)
            if len(good):
                self.threshold[k] = lo[good[0]]

    def select_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text, (kind, start, end, probability) of the redactions, none overlapping, by place. All candidates are scored together."""
        found = [(i, *c) for i, t in enumerate(texts) if t for c in candidates(t)]
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not found:
            return out
        x = np.array([features(texts[i], k, a, b) for i, k, a, b in found])
        score = self.trees.score(x)
        good = np.flatnonzero(score >= self.threshold[x[:, 0].astype(np.int64)]).tolist()
        taken: dict[int, list[tuple[int, int]]] = {}
        for q in sorted(good, key=lambda q: (found[q][0], -score[q], found[q][2] - found[q][3], found[q][2], found[q][1])):
            i, k, a, b = found[q]
            mine = taken.setdefault(i, [])
            at = bisect_left(mine, (a, b))
            if (at == 0 or mine[at - 1][1] <= a) and (at == len(mine) or mine[at][0] >= b):
                mine.insert(at, (a, b))
                lo, p = self.calibration[k]
                out[i].append((k, a, b, float(p[max(0, int(np.searchsorted(lo, score[q], "right")) - 1)])))
        return [sorted(spans, key=lambda s: s[1]) for spans in out]

    def select(self, text: str) -> list[tuple[int, int, int, float]]:
        return self.select_all([text])[0]

    def redact_all(self, texts: list[str | None]) -> list[str | None]:
        done = list(texts)
        for i, spans_ in enumerate(self.select_all(texts)):
            if spans_:
                out, at = [], 0
                for k, a, b, _ in spans_:
                    out += [texts[i][at:a], f"[{KINDS[k].upper()}]"]
                    at = b
                done[i] = "".join([*out, texts[i][at:]])
        return done

    def redact(self, text: str) -> str:
        return self.redact_all([text])[0]


_MODEL: list[Model] = []


def model() -> Model:
    """Fitted once per process, the same in each: the examples are seeded."""
    if not _MODEL:
        _MODEL.append(Model())
    return _MODEL[0]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, length, probability) of the selected redactions, in characters."""
    shipped = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                rows = [(d, KINDS[k], a, e - a, round(p, 4)) for d, found in zip(part["doc_id"], m.select_all(part["text"].tolist())) for k, a, e, p in found]
                out = pd.DataFrame(rows, columns=["doc_id", "kind", "start", "length", "probability"])
                yield out.astype({"doc_id": "Int64", "start": "int32", "length": "int32", "probability": "float64"})

    texts = id_text(docs, id_col, text_col)
    return texts.filter(texts["text"].rlike(HAS_CANDIDATE)).mapInPandas(run, "doc_id long, kind string, start int, length int, probability double")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span replaced by its kind in brackets; only texts that may hold a candidate leave the JVM."""
    shipped = docs.sparkSession.sparkContext.broadcast(model())

    @F.arrow_udf("string")
    def clean(col: pa.Array) -> pa.Array:
        m = shipped.value
        return pa.array([t for at in range(0, len(col), 1024) for t in m.redact_all(col.slice(at, 1024).to_pylist())], pa.string())

    t = F.col(f"`{text_col}`")
    # the UDF sees null instead of a text that it could not change
    masked = clean(F.when(t.rlike(HAS_CANDIDATE), t))
    return docs.select(*[F.coalesce(masked, t).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
