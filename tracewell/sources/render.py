"""Events as the API's JSON: camelCase, absent fields left out, properties as the producer ordered them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.vocab import level_name_col
from tracewell.plans.compiler import rfc3339_col
from tracewell.plans.view import View


def hex_event_id(n: Column) -> Column:
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def event_json(view: View) -> Column:
    """One JSON object per row. Typed properties become an object; stored ones keep their exact text."""
    c, have = view.columns, set(view.df.columns)
    kind = {"logs": "log", "traces": "span", "metrics": "metric"}[view.signal]
    fields = [hex_event_id(F.col("id")).alias("id"), F.lit(kind).alias("signal"), rfc3339_col(c["timestamp"]).alias("timestamp")]
    if "observed_ns" in have:
        fields.append(rfc3339_col(F.col("observed_ns")).alias("observedTimestamp"))
    fields += [c[k].alias(k) for k in ("service", "environment", "traceId", "spanId") if k in c]

    def own(name: str, label: str) -> None:
        if name in have:
            fields.append(F.col(name).alias(label))

    if view.signal == "logs":
        fields += [level_name_col(c["level"]).alias("level")] if "level" in c else []
        fields.append(c["message"].alias("message"))
        own("message_template", "messageTemplate")
        if "exception" in have:
            x = F.col("exception")
            fields.append(F.when(x.isNotNull(), F.struct(x["type"].alias("type"), x["message"].alias("message"), x["stack_trace"].alias("stackTrace"))).alias("exception"))
    else:
        fields.append(c["message"].alias("name"))
    if view.signal == "traces":
        for name, label in (("parent_span_id", "parentSpanId"), ("span_kind", "spanKind"), ("duration_ns", "durationNanos"), ("duration_ms", "durationMs"), ("status", "status")):
            own(name, label)
    if view.signal == "metrics":
        for name, label in (("description", "description"), ("unit", "unit"), ("metric_kind", "metricKind"), ("temporality", "temporality"), ("monotonic", "monotonic"), ("value", "value"), ("hist", "histogram")):
            own(name, label)
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    if "attributes_json" in have:
        props, resource = F.col("attributes_json"), F.col("resource_json")
    else:
        props = F.to_json(F.struct(*(col.alias(p) for p, (_, col) in sorted(view.typed.items()))), {"ignoreNullFields": "true"}) if view.typed else F.lit("{}")
        resource = F.lit("{}")
    return F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"properties":'), props, F.lit(',"resource":'), resource, F.lit("}"))
