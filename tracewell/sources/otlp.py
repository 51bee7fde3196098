"""OpenTelemetry requests, as JSON or protobuf, to rows of the three signals.

One table of the public messages drives both decoders; both give dictionaries with the same names.
"""

from __future__ import annotations

import base64
import json
import math
import re
import struct
import time
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from tracewell.functions.values import display, normalise, to_json
from tracewell.functions.vocab import level_code, level_from_severity, normalise_id
from tracewell.sources.columns import as_row
from tracewell.sources.native import INFORMATION, IngestError, Limits, TooDeep, frame_of

#: The public messages, name -> {field number: (name, kind)}. A kind in brackets repeats.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "logs": {1: ("resource_logs", "[ResourceLogs]")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scope_logs", "[ScopeLogs]")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("log_records", "[LogRecord]")},
    "LogRecord": {1: ("time_unix_nano", "u64"), 2: ("severity_number", "enum"), 3: ("severity_text", "string"), 5: ("body", "AnyValue"), 6: ("attributes", "[KeyValue]"), 9: ("trace_id", "id"), 10: ("span_id", "id"), 11: ("observed_time_unix_nano", "u64"), 12: ("event_name", "string")},
    "traces": {1: ("resource_spans", "[ResourceSpans]")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scope_spans", "[ScopeSpans]")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "[Span]")},
    "Span": {1: ("trace_id", "id"), 2: ("span_id", "id"), 4: ("parent_span_id", "id"), 5: ("name", "string"), 6: ("kind", "enum"), 7: ("start_time_unix_nano", "u64"), 8: ("end_time_unix_nano", "u64"), 9: ("attributes", "[KeyValue]"), 11: ("events", "[Event]"), 13: ("links", "[Link]"), 15: ("status", "Status")},
    "Event": {1: ("time_unix_nano", "u64"), 2: ("name", "string"), 3: ("attributes", "[KeyValue]")},
    "Link": {1: ("trace_id", "id"), 2: ("span_id", "id"), 4: ("attributes", "[KeyValue]")},
    "Status": {2: ("message", "string"), 3: ("code", "enum")},
    "metrics": {1: ("resource_metrics", "[ResourceMetrics]")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scope_metrics", "[ScopeMetrics]")},
    "ScopeMetrics": {1: ("scope", "Scope"), 2: ("metrics", "[Metric]")},
    "Metric": {1: ("name", "string"), 2: ("description", "string"), 3: ("unit", "string"), 5: ("gauge", "Numbers"), 7: ("sum", "Numbers"), 9: ("histogram", "Histograms"), 10: ("exponential_histogram", "Exponentials"), 11: ("summary", "Summaries")},
    "Numbers": {1: ("data_points", "[Number]"), 2: ("aggregation_temporality", "enum"), 3: ("is_monotonic", "bool")},
    "Histograms": {1: ("data_points", "[HistogramPoint]"), 2: ("aggregation_temporality", "enum")},
    "Exponentials": {1: ("data_points", "[ExponentialPoint]"), 2: ("aggregation_temporality", "enum")},
    "Summaries": {1: ("data_points", "[SummaryPoint]")},
    "Number": {3: ("time_unix_nano", "u64"), 4: ("as_double", "double"), 6: ("as_int", "i64"), 7: ("attributes", "[KeyValue]")},
    "HistogramPoint": {3: ("time_unix_nano", "u64"), 4: ("count", "u64"), 5: ("sum", "double"), 6: ("bucket_counts", "[u64]"), 7: ("explicit_bounds", "[double]"), 9: ("attributes", "[KeyValue]"), 11: ("min", "double"), 12: ("max", "double")},
    "ExponentialPoint": {1: ("attributes", "[KeyValue]"), 3: ("time_unix_nano", "u64"), 4: ("count", "u64"), 5: ("sum", "double"), 12: ("min", "double"), 13: ("max", "double")},
    "SummaryPoint": {3: ("time_unix_nano", "u64"), 4: ("count", "u64"), 5: ("sum", "double"), 7: ("attributes", "[KeyValue]")},
    "Resource": {1: ("attributes", "[KeyValue]")},
    "Scope": {1: ("name", "string"), 2: ("version", "string")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("string_value", "string"), 2: ("bool_value", "bool"), 3: ("int_value", "varint"), 4: ("double_value", "double"), 5: ("array_value", "Values"), 6: ("kvlist_value", "KeyValues"), 7: ("bytes_value", "bytes")},
    "Values": {1: ("values", "[AnyValue]")},
    "KeyValues": {1: ("values", "[KeyValue]")},
}
SPAN_KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
STATUS_CODES = ("Unset", "Ok", "Error")
TEMPORALITIES = ("Unspecified", "Delta", "Cumulative")
#: Enum names by rule, as in the public protocol.
ENUMS = {f"SEVERITY_NUMBER_{w}{n or ''}": 4 * k + (n or 1) for k, w in enumerate(("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")) for n in (0, 2, 3, 4)}
ENUMS |= {f"{prefix}_{w.upper()}": i for prefix, words in (("SPAN_KIND", SPAN_KINDS), ("STATUS_CODE", STATUS_CODES), ("AGGREGATION_TEMPORALITY", TEMPORALITIES)) for i, w in enumerate(words)}
ENUMS["SEVERITY_NUMBER_UNSPECIFIED"] = 0


def malformed(why: object) -> IngestError:
    return IngestError(f"invalid OTLP payload: {why}")


# --- JSON ---------------------------------------------------------------------


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def _int(v: Any, low: int, high: int) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, str, float)):
        raise malformed(f"expected an integer, not {v!r}")
    try:
        n = int(v)
    except (ValueError, OverflowError):
        raise malformed(f"invalid integer {v!r}") from None
    if n != v and not isinstance(v, str) or not low <= n <= high:
        raise malformed(f"integer {v!r} is out of range")
    return n


def _double(v: Any) -> float:
    if isinstance(v, str) and v in ("NaN", "Infinity", "-Infinity"):
        return float(v.replace("Infinity", "inf"))
    try:
        if isinstance(v, bool):
            raise ValueError
        return float(v)
    except (TypeError, ValueError):
        raise malformed(f"expected a number, not {v!r}") from None


def _id_bytes(v: Any) -> bytes:
    if not isinstance(v, str):
        raise malformed("ids must be strings")
    if re.fullmatch(r"(?:[0-9A-Fa-f]{2})*", v):
        return bytes.fromhex(v)
    try:
        return base64.b64decode(v, validate=True)
    except ValueError:
        raise malformed(f"invalid id {v!r}") from None


#: Of each message, the names of its fields in both spellings.
_NAMES = {kind: {spelling: (name, inner) for name, inner in fields.values() for spelling in (_camel(name), name)} for kind, fields in MESSAGES.items()}


def from_json(kind: str, v: Any) -> Any:
    if kind.startswith("["):
        if not isinstance(v, list):
            raise malformed("expected an array")
        return [from_json(kind[1:-1], x) for x in v]
    if kind in MESSAGES:
        if not isinstance(v, dict):
            raise malformed("expected an object")
        out = {}
        names = _NAMES[kind]
        for key, x in v.items():
            if x is not None and key in names:
                name, inner = names[key]
                if key != name or name not in out:  # the camel-case name goes before the other
                    out[name] = from_json(inner, x)
        return out
    if kind == "string":
        if not isinstance(v, str):
            raise malformed(f"expected a string, not {v!r}")
        return v
    if kind == "bool":
        if not isinstance(v, bool):
            raise malformed(f"expected true or false, not {v!r}")
        return v
    if kind == "enum":
        return ENUMS[v] if isinstance(v, str) and v in ENUMS else _int(v, -(2**31), 2**31 - 1)
    if kind == "bytes":
        try:
            return base64.b64decode(v)
        except (TypeError, ValueError):
            raise malformed("invalid base64") from None
    return {"u64": lambda: _int(v, 0, 2**64 - 1), "i64": lambda: _int(v, -(2**63), 2**63 - 1), "varint": lambda: _int(v, -(2**63), 2**63 - 1), "double": lambda: _double(v), "id": lambda: _id_bytes(v)}[kind]()


# --- protobuf -----------------------------------------------------------------


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise malformed("invalid varint")
        b = data[at]
        n |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return n & (2**64 - 1), at
        shift += 7


def _scalar(kind: str, wire: int, v: Any) -> Any:
    if wire == 1:
        raw = struct.pack("<Q", v)
        return struct.unpack("<d", raw)[0] if kind == "double" else struct.unpack("<q", raw)[0] if kind == "i64" else v
    if wire == 0:
        signed = v - 2**64 if v >= 2**63 else v
        return bool(v) if kind == "bool" else signed if kind in ("varint", "i64", "enum") else v
    raise malformed(f"wire type {wire} for {kind}")


_WIRE = {"u64": 1, "i64": 1, "double": 1, "varint": 0, "bool": 0, "enum": 0}


def from_proto(kind: str, data: memoryview, depth: int = 0) -> dict:
    if depth > 100:
        raise TooDeep(Limits().max_depth)
    fields, out, at = MESSAGES[kind], {}, 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            v, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise malformed("message is cut off")
            v, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise malformed("message is cut off")
            v, at = data[at : at + size], at + size
        else:
            raise malformed(f"unknown wire type {wire}")
        if number not in fields:
            continue
        name, inner = fields[number]
        many, one = inner.startswith("["), inner.strip("[]")
        if one in MESSAGES:
            if wire != 2:
                raise malformed(f"wire type {wire} for a message")
            found = [from_proto(one, v, depth + 1)]
        elif one in ("string", "id", "bytes"):
            if wire != 2:
                raise malformed(f"wire type {wire} for {one}")
            try:
                found = [bytes(v).decode() if one == "string" else bytes(v)]
            except UnicodeDecodeError:
                raise malformed("invalid UTF-8 in a string") from None
        elif many and wire == 2:  # packed
            if len(v) % 8:
                raise malformed("packed numbers are cut off")
            found = [_scalar(one, 1, int.from_bytes(v[k : k + 8], "little")) for k in range(0, len(v), 8)]
        else:
            if wire != _WIRE[one]:
                raise malformed(f"wire type {wire} for {one}")
            found = [_scalar(one, wire, v)]
        if many:
            out.setdefault(name, []).extend(found)
        else:
            if kind == "AnyValue":  # one of its fields: the last one sent
                out.clear()
            out[name] = found[0]
    return out


def _varint_bytes(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def to_proto(kind: str, value: dict) -> bytes:
    """A message in the decoder's dictionaries as protobuf, by the public wire format."""
    out = bytearray()
    numbers = {name: (number, k) for number, (name, k) in MESSAGES[kind].items()}

    def sized(number: int, raw: bytes) -> None:
        out.extend(_varint_bytes(number << 3 | 2) + _varint_bytes(len(raw)) + raw)

    for name, v in value.items():
        number, k = numbers[name]
        inner, form = k.strip("[]"), {"u64": "<Q", "i64": "<q", "double": "<d"}.get(k.strip("[]"))
        if k.startswith("[") and form:
            sized(number, b"".join(struct.pack(form, x) for x in v))
            continue
        for x in v if k.startswith("[") else [v]:
            if inner in MESSAGES or inner in ("string", "id", "bytes"):
                sized(number, to_proto(inner, x) if inner in MESSAGES else x.encode() if inner == "string" else x)
            elif form:
                out.extend(_varint_bytes(number << 3 | 1) + struct.pack(form, x))
            else:
                out.extend(_varint_bytes(number << 3) + _varint_bytes(int(x)))
    return bytes(out)


def proto_bodies(bodies: DataFrame, signal: str) -> DataFrame:
    """JSON request bodies as protobuf ones, in a binary column body."""
    from pyspark.sql import functions as F

    @F.udf("binary", useArrow=True)
    def encode(body):
        return to_proto(signal, from_json(signal, json.loads(body)))

    return bodies.select(encode(F.col(bodies.columns[0])).alias("body"))


# --- mapping ------------------------------------------------------------------


def any_value(v: dict | None, limits: Limits, depth: int = 0) -> Any:
    if depth > limits.max_depth:
        raise TooDeep(limits.max_depth)
    for name, x in (v or {}).items():
        if name == "array_value":
            return [any_value(y, limits, depth + 1) for y in x.get("values", [])]
        if name == "kvlist_value":
            return bag(x.get("values", []), limits, depth + 1)
        if name == "bytes_value":
            return base64.b64encode(x).decode()
        return normalise(x)
    return None


def bag(pairs: list[dict], limits: Limits, depth: int = 0) -> dict:
    return {p.get("key", ""): any_value(p.get("value"), limits, depth) for p in pairs}


def _id(raw: bytes | None) -> str | None:
    return normalise_id(raw.hex()) if raw else None


def _ns(n: int | None) -> int | None:
    return min(n, 2**63 - 1) if n else None


def _pick(words: tuple, n: int | None) -> str:
    return words[max(0, min(n or 0, len(words) - 1))]


@dataclass
class Decoded:
    """The events of a request; rejected records are counted, with the reason of the first."""

    events: list[dict] = field(default_factory=list)
    rejected: int = 0
    reason: str | None = None

    def reject(self, why: str) -> None:
        self.rejected += 1
        self.reason = self.reason or why

    @property
    def rows(self) -> list[dict]:
        return [as_row(**e) for e in self.events]


@dataclass
class Sent:
    """A record as it was sent, and what it is mapped with: its attributes, those of its resource, limits and the time of arrival."""

    record: dict
    attributes: dict
    resource: dict
    limits: Limits
    now: int
    lifted: dict = field(default_factory=dict)

    def lift(self, keys: dict[str, str]) -> None:
        """Takes attributes out, as texts, under the names that keys give them; of two keys of a name the first sent in keys' order is taken."""
        for key, name in keys.items():
            if self.lifted.get(name) is None:
                v = self.attributes.pop(key, None)
                self.lifted[name] = v if v is None or isinstance(v, str) else display(v)

    def of_resource(self, *keys: str) -> str | None:
        return next((v for k in keys if isinstance(v := self.resource.get(k), str) and v), None)

    def text(self, name: str) -> str | None:
        return self.record.get(name) or None

    def time(self, *names: str) -> int:
        return next((ns for n in names if (ns := _ns(self.record.get(n)))), self.now)

    def bag_of(self, pairs: list[dict]) -> dict:
        return bag(pairs, self.limits)


#: Attributes of log records that are columns.
LIFTED = {"exception.type": "type", "exception.message": "message", "exception.stacktrace": "stack_trace", "{OriginalFormat}": "template", "message_template.text": "template"}
EXCEPTION_PARTS = ("type", "message", "stack_trace")
#: The forms of metric data, and the kinds they are kept as.
FORMS = {"gauge": "gauge", "sum": "sum", "histogram": "histogram", "exponential_histogram": "histogram", "summary": "histogram"}


def _log_level(s: Sent) -> int:
    """By number, else by text, else Information; a text that says something else is kept."""
    text = s.record.get("severity_text", "")
    named = level_code(text)
    level = level_from_severity(s.record.get("severity_number", 0)) or named or INFORMATION
    if text and named != level:
        s.attributes["severityText"] = text
    return level


def _log_message(s: Sent) -> str:
    """The body as text; of an object its message, and the object is kept. Without a body what the exception says."""
    body = any_value(s.record.get("body"), s.limits)
    if isinstance(body, dict):
        s.attributes["body"] = body
        return display(body["message"]) if "message" in body else to_json(body)
    return s.lifted["message"] or "" if body is None else display(body)


def _exception(s: Sent) -> dict | None:
    parts = {k: s.lifted[k] for k in EXCEPTION_PARTS}
    return parts if any(v is not None for v in parts.values()) else None


def _span_ns(s: Sent) -> int:
    return max(0, s.record.get("end_time_unix_nano", 0) - s.record.get("start_time_unix_nano", 0))


def _span_events(s: Sent) -> list[dict]:
    start = s.time("start_time_unix_nano")
    return [{"ts_ns": _ns(e.get("time_unix_nano")) or start, "name": e.get("name", ""), "attributes": to_json(s.bag_of(e.get("attributes", [])))} for e in s.record.get("events", [])]


def _span_links(s: Sent) -> list[dict]:
    """Links that name a span."""
    ids = ((_id(x.get("trace_id")), _id(x.get("span_id")), x) for x in s.record.get("links", []))
    return [{"trace_id": t, "span_id": n, "attributes": to_json(s.bag_of(x.get("attributes", [])))} for t, n, x in ids if t and n]


def _status(s: Sent) -> dict:
    sent = s.record.get("status", {})
    return {"code": _pick(STATUS_CODES, sent.get("code")), "message": sent.get("message") or None}


def _number(s: Sent) -> float | None:
    p = s.record
    if p["form"] not in ("gauge", "sum"):
        return None
    return p["as_double"] if "as_double" in p else float(p["as_int"]) if "as_int" in p else math.nan


def _histogram(s: Sent) -> dict | None:
    """What a distribution sums up to; the sums of summaries that send none are 0."""
    p = s.record
    if p["form"] in ("gauge", "sum"):
        return None
    none = 0.0 if p["form"] == "summary" else None
    return {"count": Decimal(p.get("count", 0)), "sum": p.get("sum", none), "min": p.get("min"), "max": p.get("max"), "bucket_counts": [Decimal(n) for n in p.get("bucket_counts", [])], "bounds": p.get("explicit_bounds", [])}


#: Of each signal's columns, what it is worked out with, in this order.
COMMON = {"service": lambda s: s.of_resource("service.name"), "environment": lambda s: s.of_resource("deployment.environment.name", "deployment.environment"), "trace_id": lambda s: _id(s.record.get("trace_id")), "span_id": lambda s: _id(s.record.get("span_id"))}
DERIVED = {
    "logs": {
        "ts_ns": lambda s: s.time("time_unix_nano", "observed_time_unix_nano"), "observed_ns": lambda s: s.time("observed_time_unix_nano"), "level": _log_level,
        "message_template": lambda s: s.lifted["template"], "message": _log_message, "exception": _exception,
    },
    "traces": {
        "ts_ns": lambda s: s.time("start_time_unix_nano"), "observed_ns": lambda s: s.now, "message": lambda s: s.record.get("name", ""), "parent_span_id": lambda s: _id(s.record.get("parent_span_id")),
        "span_kind": lambda s: _pick(SPAN_KINDS, s.record.get("kind")), "duration_ns": lambda s: min(_span_ns(s), 2**63 - 1), "duration_ms": lambda s: _span_ns(s) / 1e6,
        "status": _status, "events": _span_events, "links": _span_links,
    },
    "metrics": {
        "ts_ns": lambda s: s.time("time_unix_nano"), "observed_ns": lambda s: s.now, "message": lambda s: s.record.get("metric", {}).get("name", ""), "description": lambda s: s.record["metric"].get("description") or None,
        "unit": lambda s: s.record["metric"].get("unit") or None, "metric_kind": lambda s: FORMS[s.record["form"]], "temporality": lambda s: s.record["temporality"], "monotonic": lambda s: s.record["monotonic"],
        "value": _number, "hist": _histogram,
    },
}
#: Of each signal, the names of the lists that hold resources, scopes and records.
LISTS = {"logs": ("resource_logs", "scope_logs", "log_records"), "traces": ("resource_spans", "scope_spans", "spans"), "metrics": ("resource_metrics", "scope_metrics", "metrics")}


def _points(metrics: list[tuple], out: Decoded) -> list[tuple]:
    """The data points of metrics, each with its metric and what that says of its points."""
    points = []
    for metric, scope, resource in metrics:
        form = next((f for f in FORMS if f in metric), None)
        if form is None:
            out.reject("metric without data")
            continue
        data = metric[form]
        temporality = {"summary": "cumulative", "gauge": "unspecified"}.get(form) or _pick(TEMPORALITIES, data.get("aggregation_temporality")).lower()
        said = {"metric": metric, "form": form, "temporality": temporality, "monotonic": form == "sum" and data.get("is_monotonic", False)}
        points += [({**p, **said}, scope, resource) for p in data.get("data_points", [])]
    return points


def map_request(signal: str, request: dict, now: int, limits: Limits) -> Decoded:
    """The records of a decoded request as events."""
    outer, middle, inner = LISTS[signal]
    out, records = Decoded(), []
    for r in request.get(outer, []):
        resource = bag((r.get("resource") or {}).get("attributes", []), limits)
        records += [(x, s.get("scope") or {}, resource) for s in r.get(middle, []) for x in s.get(inner, [])]
    if signal == "metrics":
        limits.events(sum(len(m[f].get("data_points", [])) for m, *_ in records for f in FORMS if f in m))
        records = _points(records, out)
    else:
        limits.events(len(records))
    for x, scope, resource in records:
        sent = Sent(x, bag(x.get("attributes", []), limits), resource, limits, now)
        if scope.get("name"):
            sent.attributes.setdefault("otel.scope.name", scope["name"])
        if signal == "logs":
            if x.get("event_name"):
                sent.attributes["event.name"] = x["event_name"]
            sent.lift(LIFTED)
        columns = {name: work(sent) for table in (COMMON, DERIVED[signal]) for name, work in table.items()}
        if signal == "traces" and (columns["trace_id"] is None or columns["span_id"] is None):
            out.reject("span without trace id or span id")
            continue
        out.events.append({**columns, "attributes": sent.attributes, "resource": resource})
    return out


def decode(signal: str, body: bytes | str, encoding: str = "json", now: int | None = None, limits: Limits = Limits()) -> Decoded:
    """All records of one request. Records that can't be kept are counted; anything malformed refuses the request."""
    if encoding == "json":
        try:
            request = from_json(signal, json.loads(body))
        except RecursionError:
            raise TooDeep(limits.max_depth) from None
        except (json.JSONDecodeError, UnicodeDecodeError) as e:
            raise malformed(e) from None
    else:
        request = from_proto(signal, memoryview(body if isinstance(body, bytes) else bytes(body)))
    return map_request(signal, request, time.time_ns() if now is None else now, limits)


def decode_frame(bodies: DataFrame, signal: str, encoding: str = "json", now: int | None = None, limits: Limits = Limits(), on_error: str = "fail") -> DataFrame:
    """Rows from a frame of request bodies, text for JSON and binary for protobuf."""
    return frame_of(bodies, lambda body, at: decode(signal, body, encoding, at, limits).events, signal, now, on_error)


def rejections(bodies: DataFrame, signal: str, encoding: str = "json", limits: Limits = Limits()) -> DataFrame:
    """Per request body: accepted, rejected and the reason of the first rejection, as in a partial success; error where the request is refused."""
    from pyspark.sql import functions as F

    @F.pandas_udf("accepted long, rejected long, reason string, error string")
    def judge(column):
        import pandas as pd

        rows = []
        for body in column:
            try:
                d = decode(signal, body, encoding, 0, limits)
                rows.append((len(d.events), d.rejected, d.reason, None))
            except IngestError as e:
                rows.append((0, 0, None, str(e)))
        return pd.DataFrame(rows, columns=["accepted", "rejected", "reason", "error"])

    return bodies.select(judge(F.col(bodies.columns[0])).alias("r")).select("r.*")
