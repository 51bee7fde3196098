"""Editing filters: the helpers of query builders, on trees instead of text."""

from __future__ import annotations

import re
from typing import Any

from tracewell.functions.times import UNITS
from tracewell.plans.ast import And, Comparison, Expr, Not, Or, conjunction, literal
from tracewell.plans.parser import ParseError, parse

_PLAIN = re.compile(r"[^\W\d]|[@$]")
_KEYWORDS = {"and", "or", "not", "contains", "true", "false", "null"}
#: The ranges that charts and searches offer.
RANGES = ("5m", "15m", "1h", "6h", "24h", "7d", "30d")


def is_plain_field(name: str) -> bool:
    """Whether a name can be written in a query."""
    return bool(re.fullmatch(r"(?:[^\W\d]|[@$])[\w.\-@$]*", name)) and not name.endswith(".") and name.lower() not in _KEYWORDS


def clause(field: str, value: Any, negate: bool = False) -> str | None:
    """Text of a comparison, or None if the field or the value can't be written."""
    if not is_plain_field(field) or isinstance(value, (dict, list)):
        return None
    return f"{field} {'!=' if negate else '='} {literal(value)}"


def and_query(current: str, extra: str) -> str:
    """current and extra; extra is not repeated, and an 'or' gets parentheses."""
    if not current.strip():
        return extra
    have, more = parse(current), parse(extra)
    if more is None or more in parts(have):
        return current
    return str(And(have, more))


def parts(e: Expr | None) -> list[Expr]:
    """What a conjunction joins; anything else is one part."""
    if e is None:
        return []
    return parts(e.left) + parts(e.right) if isinstance(e, And) else [e]


def and_parts(query: str) -> list[str] | None:
    """The comparisons of a plain conjunction, None if the query is more than that or can't be read."""
    if "(" in re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', "", query):
        return None
    try:
        found = parts(parse(query))
    except ParseError:
        return None
    return None if any(isinstance(p, (Or, Not)) for p in found) else [str(p) for p in found]


def filtered_fields(query: str) -> dict[str, Any]:
    """field -> value of the equalities in a plain conjunction."""
    if and_parts(query) is None:
        return {}
    return {p.field: p.value for p in parts(parse(query)) if isinstance(p, Comparison) and p.op == "="}


def is_filter_active(query: str, field: str, value: Any) -> bool:
    return field in (f := filtered_fields(query)) and f[field] == value and type(f[field]) is type(value)


def set_field_filter(query: str, field: str, value: Any | None) -> str | None:
    """The query with the field's equality set to value, or without it if value is None; None if the query isn't a plain conjunction."""
    if and_parts(query) is None:
        return None
    rest = [p for p in parts(parse(query)) if not (isinstance(p, Comparison) and p.op == "=" and p.field == field)]
    if value is not None:
        rest.append(Comparison(field, "=", value))
    out = conjunction(*rest)
    return "" if out is None else str(out)


def range_window(preset: str, now_ns: int, bounded: bool = False) -> tuple[int | None, int | None]:
    """[from, to) of a preset; 'all' is unbounded, or with bounded the last 30 days."""
    if preset == "all":
        if not bounded:
            return None, None
        preset = "30d"
    m = re.fullmatch(r"(\d+)([a-z]+)", preset)
    if not m or preset not in RANGES:
        raise ValueError(f"unknown range '{preset}'")
    return now_ns - int(m[1]) * UNITS[m[2]] * 1_000_000, now_ns + 1
