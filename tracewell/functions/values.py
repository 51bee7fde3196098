"""Dynamic values: numbers, text forms, path lookup and the flattened form that queries read."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from typing import Any

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_INT = re.compile(r"[+-]?[0-9]+\Z")
I64 = range(-(2**63), 2**63)


def parse_number(text: str) -> float | None:
    """The finite number that a string stands for, white space around it allowed."""
    t = text.strip()
    if not _NUMBER.match(t) or not t.isascii():
        return None
    f = float(t)
    return f if math.isfinite(f) else None


def canonical(value: Any) -> int | float | None:
    """A number in the form that equality compares: integral ones as integers, strings if they are numeric."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return value if value in I64 else canonical(float(value))
    if isinstance(value, str):
        t = value.strip()
        if _INT.match(t) and t.isascii() and int(t) in I64:
            return int(t)
        value = parse_number(t)
        if value is None:
            return None
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value.is_integer() and int(value) in I64 else value
    return None


def bool_from_str(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip().lower())


def plain_float(f: float) -> str:
    """Shortest digits that give f back, without an exponent."""
    if not math.isfinite(f):
        return {math.inf: "inf", -math.inf: "-inf"}.get(f, "NaN")
    s = format(Decimal(repr(f)), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def format_float(f: float) -> str:
    return f"{f:.1f}" if math.isfinite(f) and f.is_integer() and abs(f) < 1e15 else plain_float(f)


_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode


def _finite(v: Any) -> Any:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    return [_finite(x) for x in v] if isinstance(v, list) else v


def to_json(value: Any) -> str:
    """Compact JSON; floats that aren't finite are null."""
    try:
        return _ENCODE(value)
    except ValueError:
        return _ENCODE(_finite(value))


def display(value: Any) -> str:
    """Text for grouping and facets: scalars as they read, containers as JSON."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return format_float(value)
    return value if isinstance(value, str) else str(value) if isinstance(value, int) else to_json(value)


def normalise(value: Any) -> Any:
    """JSON as the store keeps it: integers beyond 64 bits are floats."""
    if isinstance(value, int) and not isinstance(value, bool) and value not in I64:
        return float(value)
    if isinstance(value, dict):
        return {k: normalise(v) for k, v in value.items()}
    return [normalise(v) for v in value] if isinstance(value, list) else value


_ABSENT = object()


def lookup(fields: dict[str, Any], path: str, absent: Any = None) -> Any:
    """The value at a dotted path: a whole key first, then objects under shorter and longer heads."""
    if path in fields:
        return fields[path]
    at = path.find(".")
    while at >= 0:
        inner = fields.get(path[:at])
        if isinstance(inner, dict) and (found := lookup(inner, path[at + 1 :], _ABSENT)) is not _ABSENT:
            return found
        at = path.find(".", at + 1)
    return absent


def paths(fields: dict[str, Any]) -> dict[str, Any]:
    """Every path that lookup resolves, with what it finds."""
    out = dict(fields)
    for head in sorted((k for k, v in fields.items() if isinstance(v, dict)), key=len):
        for tail, v in paths(fields[head]).items():
            out.setdefault(f"{head}.{tail}", v)
    return out


def leaves(fields: dict[str, Any], prefix: str = ""):
    """(path, scalar) of every scalar; the elements of arrays stand under the array's path."""
    for k, v in fields.items():
        yield from _leaves(f"{prefix}.{k}" if prefix else k, v)


def _leaves(path: str, v: Any):
    if isinstance(v, dict):
        yield from leaves(v, path)
    elif isinstance(v, list):
        for x in v:
            yield from _leaves(path, x)
    else:
        yield path, v


def kind(value: Any) -> str:
    if value is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "string", list: "array", dict: "object"}[type(value)]


def _scalars(value: Any):
    if isinstance(value, list):
        for x in value:
            yield from _scalars(x)
    elif value is not None and not isinstance(value, dict):
        yield value


#: The views of a scalar that comparisons read: kind, the string, canonical as an integer or a float, number, boolean, text.
LEAF = ("t", "s", "ci", "cf", "num", "b", "txt")


def leaf(x: Any) -> tuple:
    """The values of LEAF for one scalar."""
    if isinstance(x, bool):
        return "bool", None, None, None, None, x, "true" if x else "false"
    if isinstance(x, int):
        c = canonical(x)
        return "int", None, c if isinstance(c, int) else None, c if isinstance(c, float) else None, float(x), None, str(x)
    if isinstance(x, float):
        c = canonical(x)
        return "float", None, c if isinstance(c, int) else None, c if isinstance(c, float) else None, x if math.isfinite(x) else None, None, format_float(x)
    # most strings are plain words
    c = canonical(x) if x and (x[0] in _NUMERIC_START or x[0].isspace()) else None
    return "string", x, c if isinstance(c, int) else None, c if isinstance(c, float) else None, None if c is None else parse_number(x), bool_from_str(x), x


_NUMERIC_START = frozenset("0123456789+-.")


def flat_rows(fields: dict[str, Any]):
    """(path, kind, text, leaves) of every path of a property bag, leaves as tuples."""
    for path, v in paths(fields).items():
        if isinstance(v, (dict, list)):
            yield path, kind(v), to_json(v), [leaf(x) for x in _scalars(v)]
        elif v is None:
            yield path, "null", "null", []
        else:
            one = leaf(v)
            yield path, one[0], one[-1], [one]


def flatten(fields: dict[str, Any]) -> dict[str, dict]:
    """The map column of a property bag: path -> kind, text and comparable leaves."""
    return {path: {"kind": k, "txt": txt, "leaves": [dict(zip(LEAF, x, strict=True)) for x in rows]} for path, k, txt, rows in flat_rows(fields)}
