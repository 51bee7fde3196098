"""The filter language over plain Python events: what compiled predicates are tested against, and what single events are filtered with."""

from __future__ import annotations

from typing import Any

from tracewell.functions.times import format_rfc3339
from tracewell.functions.values import bool_from_str, canonical, display, format_float, lookup, parse_number
from tracewell.functions.vocab import LEVELS, level_code, normalise_id
from tracewell.plans.ast import And, Comparison, Expr, Not
from tracewell.plans.compiler import time_literal
from tracewell.plans.view import KINDS, resolve

_MISSING = object()
#: Where a well-known field stands in an event.
_PLACES = {"messageTemplate": ("message_template",), "exception.type": ("exception", "type"), "exception.message": ("exception", "message"), "exception.stackTrace": ("exception", "stack_trace"), "traceId": ("trace_id",), "spanId": ("span_id",), "parentSpanId": ("parent_span_id",), "durationMs": ("duration_ms",), "status": ("status", "code"), "spanKind": ("span_kind",), "metricKind": ("metric_kind",), "timestamp": ("ts_ns",)}


def _place(event: dict, name: str) -> Any:
    for key in _PLACES.get(name, (name,)):
        event = (event or {}).get(key)
    return event


def _sign(a, b) -> int:
    return (a > b) - (a < b)


def _holds(order: int, op: str) -> bool:
    return {"=": order == 0, "!=": order != 0, ">": order > 0, ">=": order >= 0, "<": order < 0, "<=": order <= 0}[op]


def _equal(v: Any, lit: Any) -> bool:
    if isinstance(v, list):
        return any(_equal(x, lit) for x in v)
    if v is None or isinstance(v, dict) or lit is None:
        return False
    if isinstance(lit, bool):
        return v is lit if isinstance(v, bool) else isinstance(v, str) and bool_from_str(v) is lit
    if isinstance(v, bool):
        return isinstance(lit, str) and bool_from_str(lit) is v
    if isinstance(v, str) and isinstance(lit, str):
        return v == lit
    a, b = canonical(v), canonical(lit)
    return a is not None and a == b


def _number(v: Any) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    return parse_number(v) if isinstance(v, str) else float(v) if isinstance(v, (int, float)) and abs(v) < float("inf") else None


def _ordered(v: Any, op: str, lit: Any) -> bool:
    if isinstance(v, list):
        return any(_ordered(x, op, lit) for x in v)
    if lit is None or isinstance(lit, bool) or isinstance(v, dict):
        return False
    a, b = _number(v), _number(lit)
    if a is not None and b is not None:
        return _holds(_sign(a, b), op)
    return isinstance(lit, str) and isinstance(v, str) and _holds(_sign(v.encode(), lit.encode()), op)


def _contains(v: Any, needle: str) -> bool:
    if isinstance(v, list):
        return any(_contains(x, needle) for x in v)
    if v is None or isinstance(v, dict):
        return False
    return needle in (v.lower() if isinstance(v, str) else format_float(v) if isinstance(v, float) else display(v))


def compare(v: Any, c: Comparison) -> bool:
    if v is None or v is _MISSING:
        return (c.op == "=" and c.value is None) or (c.op == "!=" and c.value is not None)
    if c.op == "contains":
        return _contains(v, display(c.value).lower())
    if c.op in ("=", "!="):
        return _equal(v, c.value) == (c.op == "=")
    return _ordered(v, c.op, c.value)


def _level(code: int | None, c: Comparison) -> bool:
    if not code or c.value is None:
        return compare(code or None, c)
    if c.op == "contains":
        return display(c.value).lower() in LEVELS[code - 1].lower()
    want = level_code(c.value) if isinstance(c.value, str) else None
    return c.op == "!=" if want is None else _holds(_sign(code, want), c.op)


def _time(ns: int, c: Comparison) -> bool:
    if c.op == "contains":
        return display(c.value).lower() in format_rfc3339(ns).lower()
    at = time_literal(c.value)
    return c.op == "!=" if at is None else _holds(_sign(ns, at), c.op)


def _id(v: str | None, c: Comparison) -> bool:
    if v is None or c.value is None:
        return compare(v, c)
    if c.op == "contains":
        return display(c.value).lower() in v.lower()
    text = display(c.value).strip()
    return _holds(_sign(v, normalise_id(text) or text), c.op)


def matches(e: Expr | None, event: dict, signal: str = "logs") -> bool:
    """event: the store's column names, with attributes and resource as plain dictionaries."""
    if e is None:
        return True
    if isinstance(e, Not):
        return not matches(e.inner, event, signal)
    if not isinstance(e, Comparison):
        test = all if isinstance(e, And) else any
        return test(matches(x, event, signal) for x in (e.left, e.right))
    r = resolve(e.field, signal)
    if r.space == "field":
        v = _place(event, r.name)
        special = {"time": _time, "level": _level, "id": _id}.get(KINDS.get(r.name, ""))
        return special(v, e) if special else compare(float(v) if KINDS.get(r.name) == "num" and v is not None else v, e)
    v = _MISSING
    for space in ("attributes", "resource"):
        if v is _MISSING and r.space in ("any", space):
            v = lookup(event.get(space) or {}, r.name, _MISSING)
    return compare(v, e)
