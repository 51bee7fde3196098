"""Filter trees to Catalyst predicates.

The language is two-valued: a missing value is unequal to every literal, and `not` of that is false. SQL is three-valued. So `not` is
pushed down to the comparisons, and each comparison knows two predicates: one that is true exactly where it
holds, one that is true exactly where it doesn't. Null counts as false in either, no negation stands above them, and
plain comparisons stay plain, so Parquet gets them as filters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.times import format_rfc3339, from_unix, parse_rfc3339
from tracewell.functions.values import bool_from_str, canonical, display, parse_number
from tracewell.functions.vocab import LEVELS, level_code, normalise_id
from tracewell.plans.ast import And, Comparison, Expr, Not, Or
from tracewell.plans.view import Bound, View

_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
Pair = tuple[Column, Column]


def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def _compare(a: Column, op: str, b) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


_OPPOSITE = {"=": "!=", "!=": "=", ">": "<=", ">=": "<", "<": ">=", "<=": ">"}


def number_of(text: Column) -> Column:
    """The finite double that a text stands for, else null. Spark's own cast takes '12d' and 'inf' too."""
    d = F.trim(text).try_cast("double")
    return F.when(text.rlike(_NUMERIC) & (F.abs(d) < math.inf), d)


def float_text(x: Column) -> Column:
    """Shortest digits without an exponent; integral values under 1e15 with one decimal."""
    digits = F.rtrim(x.cast("string").cast("decimal(38,20)").cast("string"), F.lit("0"))
    whole = (F.floor(x) == x) & (F.abs(x) < 1e15)
    return F.when(whole, F.format_string("%.1f", x)).otherwise(F.rtrim(digits, F.lit(".")))


def _never(lit) -> Pair:
    return _false(), _true()


def _of_missing(c: Comparison) -> Pair:
    """For a field that no event has."""
    hit = (c.op == "=" and c.value is None) or (c.op == "!=" and c.value is not None)
    return (_true(), _false()) if hit else (_false(), _true())


def _null_test(c: Comparison, absent: Column, present: Column) -> Pair | None:
    if c.value is None:
        return (absent, present) if c.op == "=" else (present, absent) if c.op == "!=" else (_false(), _true())
    return None


def _needle(c: Comparison) -> str:
    return display(c.value).lower()


def _contains(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle))


def _flip(pair: Pair, op: str) -> Pair:
    return (pair[1], pair[0]) if op == "!=" else pair


def _text(col: Column, c: Comparison) -> Pair:
    absent = col.isNull()
    if tested := _null_test(c, absent, col.isNotNull()):
        return tested
    v, op = c.value, c.op
    if op == "contains":
        hit = _contains(col, _needle(c))
        return hit, absent | ~hit
    if op in ("=", "!="):
        if isinstance(v, bool):
            hit = F.lower(F.trim(col)) == str(v).lower()
        elif isinstance(v, str):
            return _flip((col == v, absent | (col != v)), op)
        else:
            exact = canonical(v)
            # integers compare exactly, beyond what a double holds
            as_int = F.when(col.rlike(_INTEGER), F.trim(col).try_cast("bigint"))
            hit = F.when(as_int.isNotNull(), as_int == F.lit(exact)).otherwise(number_of(col) == F.lit(float(exact))) if isinstance(exact, int) else number_of(col) == F.lit(exact)
        return _flip((hit, absent | ~F.coalesce(hit, _false())), op)
    if isinstance(v, bool):
        return _never(v)
    num = number_of(col)
    if isinstance(v, str):
        b = parse_number(v)
        if b is None:
            return _compare(col, op, v), absent | _compare(col, _OPPOSITE[op], v)
        hit = F.when(num.isNotNull(), _compare(num, op, b)).otherwise(_compare(col, op, v))
    else:
        hit = _compare(num, op, float(v))
    return hit, absent | ~F.coalesce(hit, _false())


def _num(col: Column, c: Comparison, whole: bool = False) -> Pair:
    """A double, or with whole an integer, column. NaN and infinities are there, but compare with nothing."""
    absent = col.isNull()
    if tested := _null_test(c, absent, col.isNotNull()):
        return tested
    v, op = c.value, c.op
    if op == "contains":
        hit = F.contains(col.cast("string") if whole else float_text(col), F.lit(_needle(c)))
        return hit, absent | ~F.coalesce(hit, _false())
    if isinstance(v, bool):
        pair = _never(v)
    elif op in ("=", "!="):
        exact = canonical(v)
        pair = (_false(), _true()) if exact is None else (col == F.lit(exact if whole else float(exact)), absent | (col != F.lit(exact if whole else float(exact))))
        return _flip(pair, op) if exact is not None else (pair if op == "=" else (_true(), _false()))
    else:
        b = parse_number(v) if isinstance(v, str) else float(v)
        if b is None:
            pair = _never(v)
        elif whole:
            pair = _compare(col, op, b), absent | _compare(col, _OPPOSITE[op], b)
        else:
            finite = F.abs(col) < math.inf
            hit = _compare(col, op, b)
            # upwards NaN and infinity would pass, downwards minus infinity
            pair = hit & finite, absent | ~finite | _compare(col, _OPPOSITE[op], b)
    return _flip(pair, op)


def _bool(col: Column, c: Comparison) -> Pair:
    absent = col.isNull()
    if tested := _null_test(c, absent, col.isNotNull()):
        return tested
    if c.op == "contains":
        hit = F.contains(col.cast("string"), F.lit(_needle(c)))
        return hit, absent | ~hit
    v = bool_from_str(c.value) if isinstance(c.value, str) else c.value if isinstance(c.value, bool) else None
    if c.op not in ("=", "!="):
        return _never(v)
    pair = (_false(), _true()) if v is None else (col == F.lit(v), absent | (col != F.lit(v)))
    return _flip(pair, c.op)


def _any(exists, absent: Column, c: Comparison) -> Pair:
    """exists: predicate of one element -> whether any element has it."""
    hit = F.coalesce(exists, _false())
    return _flip((hit, ~hit), c.op)


def _texts(col: Column, c: Comparison) -> Pair:
    if tested := _null_test(c, col.isNull(), col.isNotNull()):
        return tested
    one = Comparison(c.field, "=" if c.op == "!=" else c.op, c.value)
    return _any(F.exists(col, lambda x: F.coalesce(_text(x, one)[0], _false())), col.isNull(), c)


def _dyn(col: Column, c: Comparison) -> Pair:
    """A flattened property: kind, text, and leaves with every view of them worked out at ingest."""
    absent = col.isNull() | (col["kind"] == "null")
    if tested := _null_test(c, absent, ~absent):
        return tested
    v, op = c.value, c.op

    def one(x: Column) -> Column:
        t = x["t"]
        if op == "contains":
            return _contains(x["txt"], _needle(c)) if op else t
        if op in ("=", "!="):
            if isinstance(v, bool):
                return (t.isin("bool", "string")) & (x["b"] == F.lit(v))
            exact = canonical(v)
            same = F.lit(False)
            if isinstance(exact, int):
                same = x["ci"] == F.lit(exact)
            elif exact is not None:
                same = x["cf"] == F.lit(exact)
            if not isinstance(v, str):
                return same
            truth = bool_from_str(v)
            return ((t == "string") & (x["s"] == F.lit(v))) | (t.isin("int", "float") & same) | ((t == "bool") & (x["b"] == F.lit(truth)) if truth is not None else F.lit(False))
        if isinstance(v, bool):
            return F.lit(False)
        if isinstance(v, str):
            b = parse_number(v)
            text = (t == "string") & _compare(x["s"], op, v)
            return text if b is None else F.when(x["num"].isNotNull(), _compare(x["num"], op, b)).otherwise(text)
        return _compare(x["num"], op, float(v))

    return _any(F.exists(col["leaves"], lambda x: F.coalesce(one(x), _false())), absent, c)


def _level(col: Column, c: Comparison) -> Pair:
    there = col.between(1, 6)
    absent = col.isNull() | ~there
    if tested := _null_test(c, absent, there):
        return tested
    code = level_code(c.value) if isinstance(c.value, str) else None
    if c.op == "contains":
        codes = [k for k, name in enumerate(LEVELS, 1) if _needle(c) in name.lower()]
        return col.isin(codes), absent | ~col.isin(codes)
    if code is None:
        return (_true(), _false()) if c.op == "!=" else (_false(), _true())
    if c.op in ("=", "!="):
        return _flip((col == code, col.isNull() | (col != code)), c.op)
    return _compare(col, c.op, code) & there, absent | _compare(col, _OPPOSITE[c.op], code)


def time_literal(v) -> int | None:
    """Numbers go through a double, as the language has it."""
    if isinstance(v, str):
        ns = parse_rfc3339(v)
        n = parse_number(v)
        return ns if ns is not None else from_unix(n) if n is not None else None
    return None if v is None or isinstance(v, bool) else from_unix(float(v))


def rfc3339_col(ns: Column) -> Column:
    sub = F.pmod(ns, F.lit(1_000_000_000))
    head = F.date_format(F.timestamp_seconds(F.floor((ns - sub) / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.lpad(sub.cast("string"), 9, "0")
    tail = F.when(sub == 0, "").when(sub % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3))).when(sub % 1000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6))).otherwise(F.concat(F.lit("."), digits))
    return F.concat(head, tail, F.lit("Z"))


def _time(col: Column, c: Comparison, ts: str | None) -> Pair:
    if c.value is None:
        return (_true(), _false()) if c.op == "!=" else (_false(), _true())
    if c.op == "contains":
        hit = _contains(rfc3339_col(col), _needle(c))
        return hit, ~hit
    at = time_literal(c.value)
    if at is None:
        return (_true(), _false()) if c.op == "!=" else (_false(), _true())
    if ts and at % 1000 == 0:
        when = F.timestamp_micros(F.lit(at // 1000))
        return _compare(F.col(ts), c.op, when), _compare(F.col(ts), _OPPOSITE[c.op], when)
    return _compare(col, c.op, F.lit(at)), _compare(col, _OPPOSITE[c.op], F.lit(at))


def _id(col: Column, c: Comparison) -> Pair:
    absent = col.isNull()
    if tested := _null_test(c, absent, col.isNotNull()):
        return tested
    if c.op == "contains":
        hit = _contains(col, _needle(c))
        return hit, absent | ~hit
    text = display(c.value).strip()
    text = normalise_id(text) or text
    pair = _compare(col, c.op, text), absent | _compare(col, _OPPOSITE[c.op], text)
    return (absent | pair[0], _compare(col, "=", text)) if c.op == "!=" else pair


def comparison(c: Comparison, view: View) -> Pair:
    b: Bound = view.bind(c.field)
    if b.kind == "none":
        return _of_missing(c)
    if b.kind == "time":
        return _time(b.column, c, view.ts)
    if b.kind == "int":
        return _num(b.column, c, True)
    return {"text": _text, "num": _num, "bool": _bool, "texts": _texts, "dyn": _dyn, "level": _level, "id": _id}[b.kind](b.column, c)


def predicate(e: Expr | None, view: View, wanted: bool = True) -> Column:
    """True exactly on the events that match (with wanted False: that don't); elsewhere false or null."""
    if e is None:
        return F.lit(wanted)
    if isinstance(e, Comparison):
        return comparison(e, view)[0 if wanted else 1]
    if isinstance(e, Not):
        return predicate(e.inner, view, not wanted)
    parts = [predicate(x, view, wanted) for x in _flat(e)]
    while len(parts) > 1:  # balanced, so that long chains stay shallow
        parts = [(parts[i] & parts[i + 1] if isinstance(e, And) == wanted else parts[i] | parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _flat(e: Expr) -> list[Expr]:
    kind = type(e)
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if isinstance(x, kind) and kind in (And, Or):
            todo += [x.right, x.left]
        else:
            out.append(x)
    return out


def flag(e: Expr | None, view: View) -> Column:
    """The predicate as a boolean without nulls, for projections."""
    return F.coalesce(predicate(e, view), F.lit(False))


def in_range(view: View, start: int | None, stop: int | None) -> Column | None:
    """[start, stop) in nanoseconds, repeated on coarser columns where the view has them."""
    ns, out = view.columns["timestamp"], []
    for op, at in ((">=", start), ("<", stop)):
        if at is None:
            continue
        if view.ts and at % 1000 == 0:
            out.append(_compare(F.col(view.ts), op, F.timestamp_micros(F.lit(at // 1000))))
        else:
            out.append(_compare(ns, op, F.lit(at)))
        if view.date:
            day = format_rfc3339(at if op == ">=" else at - 1)[:10]
            out.append(_compare(F.col(view.date), ">=" if op == ">=" else "<=", F.lit(day).cast("date")))
    total = None
    for x in out:
        total = x if total is None else total & x
    return total


def matching(view: View, e: Expr | None, start: int | None = None, stop: int | None = None):
    """The view's rows in the range that match."""
    df = view.df
    bounds = in_range(view, start, stop)
    if bounds is not None:
        df = df.where(bounds)
    return df if e is None else df.where(predicate(e, view))
