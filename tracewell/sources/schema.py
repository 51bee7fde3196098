"""The tables of the store: one per signal, a fixed envelope plus properties."""

from __future__ import annotations

LEAF = "struct<t:string,s:string,ci:bigint,cf:double,num:double,b:boolean,txt:string>"
PROPERTY = f"struct<kind:string,txt:string,leaves:array<{LEAF}>>"

ENVELOPE = (
    "ts_ns long, observed_ns long, service string, environment string, trace_id string, span_id string, "
    f"attributes_json string, resource_json string, attr map<string,{PROPERTY}>, res map<string,{PROPERTY}>, leaf_list array<struct<path:string,text:string>>, message string"
)
PAYLOAD = {
    "logs": "level tinyint, message_template string, exception struct<type:string,message:string,stack_trace:string>",
    "traces": (
        "parent_span_id string, span_kind string, duration_ns long, duration_ms double, status struct<code:string,message:string>, "
        "events array<struct<ts_ns:bigint,name:string,attributes:string>>, links array<struct<trace_id:string,span_id:string,attributes:string>>"
    ),
    "metrics": (
        "description string, unit string, metric_kind string, temporality string, monotonic boolean, value double, "
        "hist struct<count:decimal(20,0),sum:double,min:double,max:double,bucket_counts:array<decimal(20,0)>,bounds:array<double>>"
    ),
}


def columns(signal: str) -> str:
    """Of a table before ids are given."""
    return f"{ENVELOPE}, {PAYLOAD[signal]}"


def table(signal: str) -> str:
    return f"id long, {columns(signal)}, date date"
