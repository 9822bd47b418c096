"""A reader of the YAML that configuration and entity files use: mappings, sequences (block and flow), scalars, comments.

Anchors, tags and block scalars are refused with their line. A file is small; it is parsed whole inside one task.
"""

from __future__ import annotations

import re

_NULL, _TRUE, _FALSE = {"null", "~", ""}, {"true", "yes", "on"}, {"false", "no", "off"}


class Unsupported(ValueError):
    pass


def scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1].replace("''", "'") if s[0] == "'" else bytes(s[1:-1], "utf-8").decode("unicode_escape") if "\\" in s and s.isascii() else s[1:-1]
    low = s.lower()
    if low in _NULL:
        return None
    if low in _TRUE or low in _FALSE:
        return low in _TRUE
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", s):
        return float(s)
    return s


def _cut_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _pieces(s: str, sep: str = ",") -> list[str]:
    """``s`` split at separators outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == sep and not depth:
            out.append(s[start:i])
            start = i + 1
    return [*out, s[start:]]


def _flow(s: str):
    s = s.strip()
    if s.startswith("[") and s.endswith("]"):
        return [_flow(x) for x in _pieces(s[1:-1]) if x.strip()]
    if s.startswith("{") and s.endswith("}"):
        return {str(scalar(k)): _flow(":".join(v)) for k, *v in (_pieces(x, ":") for x in _pieces(s[1:-1]) if x.strip())}
    return scalar(s)


_PAIR = re.compile(r"""^("[^"]*"|'[^']*'|[^\s:#\[\]{},&*!|>'"][^:#]*?|[^\s:]+):(?:\s+(.*))?$""")


def parse(text: str):
    lines = []
    for no, raw in enumerate(text.splitlines(), 1):
        body = _cut_comment(raw).rstrip()
        if not body.strip() or body.strip() in ("---", "..."):
            continue
        lines.append((len(body) - len(body.lstrip()), body.strip(), no))
    value, at = _block(lines, 0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines):
        raise Unsupported(f"line {lines[at][2]}: unexpected indentation")
    return value


def _value(lines, i, indent, rest, no):
    """The value after ``key:`` or ``-``: in place, or the deeper block that follows."""
    if rest:
        if rest[0] in "&*!|>" and not (rest[0] == "*" and " " in rest):
            raise Unsupported(f"line {no}: {rest[0]}")
        while rest[0] in "[{" and rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}") and i < len(lines):
            rest, i = f"{rest} {lines[i][1]}", i + 1
        return _flow(rest), i
    if i < len(lines) and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("- "))):
        return _block(lines, i, lines[i][0])
    return None, i


def _block(lines, i, indent):
    if lines[i][1] == "-" or lines[i][1].startswith("- "):
        out = []
        while i < len(lines) and lines[i][0] == indent and (lines[i][1] == "-" or lines[i][1].startswith("- ")):
            rest, no = lines[i][1][1:].strip(), lines[i][2]
            if rest and _PAIR.match(rest) and rest[0] not in "[{":  # a mapping that begins on the dash's line
                inner = indent + len(lines[i][1]) - len(lines[i][1][1:].lstrip())
                lines[i] = (inner, rest, no)
                item, i = _block(lines, i, inner)
            else:
                item, i = _value(lines, i + 1, indent, rest, no)
            out.append(item)
        return out, i
    m = _PAIR.match(lines[i][1])
    if not m:
        return _flow(lines[i][1]), i + 1
    out = {}
    while i < len(lines) and lines[i][0] == indent and (m := _PAIR.match(lines[i][1])) and not lines[i][1].startswith("- "):
        key = m[1][1:-1] if m[1][0] in "'\"" else m[1].strip()
        out[key], i = _value(lines, i + 1, indent, (m[2] or "").strip(), lines[i][2])
    return out, i
