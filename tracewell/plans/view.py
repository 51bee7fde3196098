"""A table of one signal, and how names in a query resolve to its columns.

The same language runs over tables written by the store (properties in map columns) and over any
DataFrame whose columns are named as fields of a signal; typed columns keep filters where Parquet can use them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ("logs", "traces", "metrics")

#: The names of well-known fields (compared without case), for all signals and for each.
ALIASES = {
    "*": {
        "timestamp": ("timestamp", "@t", "time"),
        "service": ("service", "service.name"),
        "environment": ("environment", "env", "deployment.environment"),
        "message": ("message", "@m", "msg"),
        "traceId": ("traceid", "trace_id", "@tr"),
        "spanId": ("spanid", "span_id", "@sp"),
    },
    "logs": {
        "level": ("level", "@l", "severity"),
        "messageTemplate": ("messagetemplate", "@mt", "template"),
        "exception.type": ("exception.type",),
        "exception.message": ("exception.message",),
        "exception.stackTrace": ("exception.stacktrace", "stacktrace", "exception", "@x"),
    },
    "traces": {
        "message": ("name", "operation"),
        "parentSpanId": ("parentspanid", "parent_span_id"),
        "durationMs": ("durationms", "duration"),
        "status": ("status",),
        "spanKind": ("spankind", "kind"),
    },
    "metrics": {"message": ("name", "metric"), "value": ("value",), "unit": ("unit",), "metricKind": ("metrickind", "type")},
}
#: How each well-known field is compared.
KINDS = {"timestamp": "time", "level": "level", "traceId": "id", "spanId": "id", "parentSpanId": "id", "durationMs": "num", "value": "num"}
#: Column names of the store's tables.
COLUMNS = {
    "timestamp": "ts_ns", "service": "service", "environment": "environment", "message": "message", "traceId": "trace_id", "spanId": "span_id",
    "level": "level", "messageTemplate": "message_template", "exception.type": "exception.type", "exception.message": "exception.message",
    "exception.stackTrace": "exception.stack_trace", "parentSpanId": "parent_span_id", "durationMs": "duration_ms", "status": "status.code",
    "spanKind": "span_kind", "value": "value", "unit": "unit", "metricKind": "metric_kind",
}


@dataclass(frozen=True)
class Bound:
    """A resolved field. kind: time, level, text, id, num, bool, texts (array of strings), dyn (property struct) or none (never there)."""

    kind: str
    column: Column | None = None


@dataclass(frozen=True)
class Resolved:
    """What a name means: a well-known field, or a property path in attributes, resource, or one before the other."""

    space: str  # field, any, attributes, resource
    name: str


def resolve(name: str, signal: str) -> Resolved:
    for prefix, space in (("attributes.", "attributes"), ("properties.", "attributes"), ("resource.", "resource")):
        if name.startswith(prefix):
            return Resolved(space, name[len(prefix) :])
    low = name.lower()
    for table in (ALIASES["*"], ALIASES[signal]):
        for known, names in table.items():
            if low in names:
                return Resolved("field", known)
    return Resolved("any", name)


@dataclass(frozen=True)
class View:
    """signal, its rows, and where fields live. typed: property path -> (kind, column), ahead of the maps.

    attributes, resource: map columns of flattened properties, or None. date: a partition column of whole
    days (UTC) to which time bounds are repeated, so that partitions are pruned. ts: a timestamp column that bounds
    compare with instead of ts_ns when they are whole microseconds, so that row groups are pruned.
    """

    signal: str
    df: DataFrame
    columns: dict[str, Column] = field(default_factory=dict)
    typed: dict[str, tuple[str, Column]] = field(default_factory=dict)
    attributes: str | None = None
    resource: str | None = None
    date: str | None = None
    ts: str | None = None

    @staticmethod
    def stored(signal: str, df: DataFrame, **more) -> View:
        """Over a table in the store's layout; columns that it lacks are fields that no event has."""
        have = set(df.columns)
        cols = {k: F.col(c) for k, c in COLUMNS.items() if c.split(".")[0] in have}
        return View(signal, df, cols, attributes="attr" if "attr" in have else None, resource="res" if "res" in have else None, date="date" if "date" in have else None, **more)

    def over(self, df: DataFrame) -> View:
        return replace(self, df=df)

    def bind(self, name: str) -> Bound:
        r = resolve(name, self.signal)
        if r.space == "field":
            column = self.columns.get(r.name)
            return Bound("none") if column is None else Bound(KINDS.get(r.name, "text"), column)
        return self.bind_property(r.name, r.space)

    def bind_property(self, path: str, space: str = "any") -> Bound:
        if space != "resource" and path in self.typed:
            return Bound(*self.typed[path])
        maps = [m for m, s in ((self.attributes, "attributes"), (self.resource, "resource")) if m and space in ("any", s)]
        found = [F.element_at(F.col(m), F.lit(path)) for m in maps]
        # an attribute that is there, even null, hides the resource's
        return Bound("dyn", found[0] if len(found) == 1 else F.coalesce(*found)) if found else Bound("none")

    def text_of(self, path: str) -> Column:
        """Display text of a property, null where it is absent."""
        b = self.bind_property(path)
        if b.kind == "dyn":
            return b.column["txt"]
        return F.lit(None).cast("string") if b.kind == "none" else b.column.cast("string")
