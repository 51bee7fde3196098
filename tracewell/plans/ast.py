"""The filter language's syntax tree, and its text form, which parses back to the same tree."""

from __future__ import annotations

from dataclasses import dataclass

OPS = ("=", "!=", ">", ">=", "<", "<=", "contains")
Literal = str | int | float | bool | None


@dataclass(frozen=True)
class Comparison:
    field: str
    op: str
    value: Literal

    def __str__(self) -> str:
        return f"{self.field} {self.op} {literal(self.value)}"


@dataclass(frozen=True)
class Not:
    inner: Expr

    def __str__(self) -> str:
        return f"not {_nested(self.inner, 3)}"


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{_nested(self.left, 2)} and {_nested(self.right, 3)}"


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{_nested(self.left, 1)} or {_nested(self.right, 2)}"


Expr = Comparison | Not | And | Or
_RANK = {Or: 1, And: 2, Not: 3, Comparison: 4}


def _nested(e: Expr, least: int) -> str:
    return f"({e})" if _RANK[type(e)] < least else str(e)


def literal(v: Literal) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            v = v.replace(a, b)
        return f'"{v}"'
    if isinstance(v, float):  # always with a point or an exponent, so that it reads as a float again
        digits, _, power = repr(v).partition("e")
        return f"{digits}e{int(power)}" if power else digits
    return str(v)


def conjunction(*parts: Expr | None) -> Expr | None:
    out = None
    for p in parts:
        out = p if out is None else out if p is None else And(out, p)
    return out


def comparisons(e: Expr | None) -> list[Comparison]:
    if e is None:
        return []
    if isinstance(e, Comparison):
        return [e]
    return comparisons(e.inner) if isinstance(e, Not) else comparisons(e.left) + comparisons(e.right)
