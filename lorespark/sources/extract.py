"""Entities, fields, relationships and rules out of parsed files: plain Python, run whole-file inside tasks."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections import Counter

from lorespark.sources import yaml_subset

ENTITY_KEYS = set("identifier golden_source match_rules pii pii_classification retention fields attributes status relationships constraints id uuid has_many has_one references depends_on primary_key".split())
RELATIONS = {"belongs_to": ("belongs-to", "1:1"), "has_many": ("has-many", "1:N"), "has_one": ("has-one", "1:1"), "references": ("references", "1:1"), "refs": ("references", "1:1"), "depends_on": ("depends-on", "1:1")}
SCOPES = "merchant tenant organization org store region account".split()
#: (kind, entity, key, value, raw, certainty, line); kind: entity, alias, field, relationship, rule, warning, note
SHAPE = "path string, fmt string, kind string, entity string, ord int, key string, value string, raw string, certainty string, line int"


def hyphened(s) -> str:
    return re.sub(r"[\s_]+", "-", str(s).strip())


def name_of(s) -> str:
    return re.sub(r"^ENTITY-", "", hyphened(s).upper())


def short(v) -> str:
    """The compact notation of a value: lists joined by +, mappings as k(v), truth values and nothing as words."""
    if v is None:
        return "none"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, list):
        return "+".join(short(x) for x in v)
    if isinstance(v, dict):
        return "+".join(f"{hyphened(k)}({short(x)})" for k, x in v.items())
    return str(v)


def _identifier(v, about: str) -> tuple[str, str]:
    if not isinstance(v, dict):
        return str(v), "explicit"
    flags, how = [], "explicit"
    for f in ("immutable", "unique", "required"):
        if v.get(f):
            scope = next((s for s in SCOPES if re.search(rf"per[ -]{s}", about.lower())), None) if f == "unique" else None
            flags.append(f"unique-per-{'org' if scope == 'organization' else scope}" if scope else f)
            how = "inferred" if scope else how
    scope = v.get("scope") or v.get("unique_per")
    if scope and not any("unique" in f for f in flags):
        flags.append(f"unique-per-{hyphened(scope)}")
    parts = ([str(v["type"])] if v.get("type") else []) + flags
    name = v.get("name", v.get("field", ""))
    return (f"{name}({','.join(parts)})" if parts else str(name)), how


def _matching(v) -> str:
    if not isinstance(v, list):
        return short(v)
    one = []
    for r in v:
        o = r.get("options") if isinstance(r, dict) else None
        one.append(f"{r.get('field', '')}:{hyphened(r.get('method', ''))}" + (f"({','.join(map(str, o)) if isinstance(o, (list, dict)) else o})" if o else "") if isinstance(r, dict) else str(r))
    return "[" + ",".join(one) + "]"


def _retention(v) -> str:
    if not isinstance(v, dict):
        return short(v)
    # a number of months keeps its unit, so that the retention check can read it
    part = lambda k, x: f"{x}-months" if k == "months" and isinstance(x, int) else str(x)
    return "|".join(f"{hyphened(k)}→" + ("→".join(part(a, b) for a, b in x.items()) if isinstance(x, dict) else str(x)) for k, x in v.items())


def _status(v) -> str:
    if isinstance(v, list):
        return "→".join(map(str, v))
    if isinstance(v, dict):
        flow = "→".join(map(str, v.get("flow", v.get("states", []))))
        return flow + (f"|terminal:{'+'.join(map(str, v['terminal']))}" if v.get("terminal") else "")
    return short(v)


def relations_of(kind: str, v) -> list[dict]:
    card = RELATIONS[kind][1]
    out = []
    for r in v if isinstance(v, list) else [v]:
        r = r if isinstance(r, dict) else {"entity": r}
        target = name_of(r.get("entity") or "")
        if target:
            out.append({"target": target, "rel_type": RELATIONS[kind][0], "via": str(r.get("field", r.get("via", ""))), "cardinality": str(r.get("cardinality", card)), "cascade": str(r.get("cascade", "")), "required": bool(r.get("required", r.get("mandatory", False)))})
    return out


def _relation_text(kind: str, v) -> str:
    parts = []
    for r in relations_of(kind, v):
        inside = [x for x in (r["via"], r["cardinality"], "mandatory" if r["required"] else "", f"cascade:{r['cascade']}" if r["cascade"] else "") if x]
        parts.append(f"@ENTITY-{r['target']}({','.join(inside)})")
    return "+".join(parts)


def field_of(key: str, v, about: str = "") -> tuple[str, str, str]:
    """(key, value, certainty) of an entity's field, by what the key means."""
    k = key.lower().replace("-", "_")
    if k == "identifier":
        return ("IDENTIFIER", *_identifier(v, about))
    if k in RELATIONS:
        return RELATIONS[k][0].upper(), _relation_text(k, v), "explicit"
    for keys, name, f in ((("golden_source",), "★GOLDEN-SOURCE", short), (("match_rules",), "MATCH-RULES", _matching), (("retention",), "RETENTION", _retention), (("status", "status_machine", "status_flow"), "STATUS-MACHINE", _status)):
        if k in keys:
            return name, f(v), "explicit"
    if k == "financial_fields" and isinstance(v, dict):
        return "FINANCIAL-FIELDS", f"[{','.join(map(str, v.get('fields', [])))}]" + (f"→{v['type']}" if v.get("type") else ""), "explicit"
    return hyphened(key).upper(), short(v), "explicit"


def _raw(v) -> str:
    return json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)


def _entity(name: str, data: dict) -> list[tuple]:
    n, about = name_of(name), str(data.get("description") or "")
    out = [("entity", n, "description", about, None, "explicit", None)]
    for k, v in data.items():
        if k in ("entity", "description"):
            continue
        if k == "aliases":
            out += [("alias", n, "alias", str(a), None, "explicit", None) for a in (v if isinstance(v, list) else [])]
            continue
        key, value, how = field_of(k, v, about)
        out.append(("field", n, key, value, _raw(v), how, None))
        rel = k.lower().replace("-", "_")
        if rel in RELATIONS:
            out += [("relationship", n, r["rel_type"], r["target"], _raw(r), "explicit", None) for r in relations_of(rel, v)]
    return out


def from_mapping(data, wide: bool = False) -> list[tuple]:
    """One entity (key ``entity``), rules (key ``rules`` or ``policies``), or a mapping of entities and rules."""
    if not isinstance(data, dict):
        return []
    if "entity" in data:
        return _entity(str(data["entity"]), data)
    rules = data.get("rules", data.get("policies") if wide else None)
    if rules is not None:
        items = [kv for r in rules if isinstance(r, dict) for kv in r.items()] if isinstance(rules, list) else list(rules.items()) if isinstance(rules, dict) else []
        return [("rule", None, hyphened(k).upper(), short(v), _raw(v), "explicit", None) for k, v in items]
    if wide and isinstance(data.get("properties"), dict):  # a JSON Schema object
        required = set(data.get("required") or [])
        n = name_of(data.get("title") or data.get("$id") or "SCHEMA")
        out = [("entity", n, "description", str(data.get("description") or ""), None, "explicit", None)]
        for k, p in data["properties"].items():
            p = p if isinstance(p, dict) else {}
            flags = [x for x in (str(p.get("format") or ""), "required" if k in required else "", f"enum:{'|'.join(map(str, p['enum']))}" if p.get("enum") else "") if x]
            out.append(("field", n, hyphened(k).upper(), f"{p.get('type', 'any')}" + (f"({','.join(flags)})" if flags else ""), _raw(p), "explicit", None))
        return out
    out: list[tuple] = []
    for k, v in data.items():
        if isinstance(v, dict) and (set(v) & ENTITY_KEYS or wide and any(isinstance(x, (dict, list)) for x in v.values())):
            out += _entity(k, v)
        elif wide and isinstance(v, list) and len(v) >= 2 and all(isinstance(x, dict) for x in v):
            common = set.intersection(*(set(x) for x in v))
            n = name_of(k)
            out += [("entity", n, "description", "", None, "explicit", None), ("field", n, "COUNT", str(len(v)), None, "explicit", None), ("field", n, "SCHEMA", "+".join(sorted(common)), None, "explicit", None)]
        else:
            out.append(("rule", None, hyphened(k).upper(), short(v), _raw(v), "explicit", None))
    return out


def _column_text(row: dict) -> str:
    yes = lambda c: (row.get(c) or "").strip().lower() in ("true", "yes", "1", "y")
    inside = [x for x in ((row.get("type") or "").strip(), "nullable" if yes("nullable") else "", "pii" if yes("pii") else "") if x]
    return (f"({','.join(inside)})" if inside else "") + (f"  # {row['description'].strip()}" if (row.get("description") or "").strip() else "")


def from_csv(text: str, stem: str) -> list[tuple]:
    """Entity by row when a column names it, else one entity for the file."""
    rows = list(csv.DictReader(io.StringIO(text)))
    rows = [{(k or "").strip().lower(): v for k, v in r.items()} for r in rows]
    by = next((c for c in ("entity", "entity_name") if rows and c in rows[0]), None)
    out, seen = [], Counter()
    for r in rows:
        n = name_of(r[by] if by else stem)
        if not n:
            continue
        if not seen[n]:
            out.append(("entity", n, "description", "", None, "explicit", None))
        seen[n] += 1
        field = (r.get("field_name") or r.get("field") or r.get("name") or next(iter(r.values())) or "").strip()
        out.append(("field", n, hyphened(field).upper(), field + _column_text(r), _raw(r), "explicit", None))
    return out


def from_toml(data: dict) -> list[tuple]:
    out: list[tuple] = []
    for n, v in (data.get("entity") or {}).items() if isinstance(data.get("entity"), dict) else ():
        out += _entity(n, v)
    rest = {k: v for k, v in data.items() if not (k == "entity" and isinstance(v, dict))}
    for k, v in rest.items():
        out += _entity(k, v) if isinstance(v, dict) and k not in ("rules", "policies") else from_mapping({k: v}, True)
    return out


def extract(fmt: str, text: str, stem: str) -> list[tuple]:
    """All rows of a file; a file that cannot be read gives one warning."""
    try:
        if fmt == "yaml":
            return from_mapping(yaml_subset.parse(text))
        if fmt == "json":
            return from_mapping(json.loads(text), True)
        if fmt == "toml":
            return from_toml(tomllib.loads(text))
        if fmt == "csv":
            return from_csv(text, stem)
    except (ValueError, KeyError, TypeError, AttributeError, csv.Error) as e:
        return [("warning", None, "unreadable", str(e)[:200], None, "explicit", None)]
    return []
