"""Ingest, the store and the read operations over it, streams and alerts."""

import base64
import json
import threading
from collections import Counter

import pytest

from tracewell.engine import Engine
from tracewell.functions.times import parse_rfc3339
from tracewell.operators import alerts, limits, search, series, traces
from tracewell.operators.facets import facets
from tracewell.operators.stats import property_stats
from tracewell.plans.parser import QueryError, parse
from tracewell.plans.view import View
from tracewell.sources import native, otlp
from tracewell.sources.render import event_json
from tracewell.sources.table import Conflict, Store
from tracewell.streaming import live

NOW = parse_rfc3339("2026-01-01T12:00:00Z")
TRACE = "4bf92f3577b34da6a3ce929d0e0e4736"


def one(**o):
    (row,) = native.parse(json.dumps(o), "json", NOW)
    return row


def test_native_events():
    r = one(**{"@t": "2026-01-01T00:00:00.5Z", "@l": "wrn", "@mt": "User {User} at {Http.Path}", "User": 7, "Http": {"Path": "/x"}, "@tr": TRACE.upper(), "service": "a", "resource": {"deployment.environment": "prod"}})
    assert (r["ts_ns"], r["level"], r["message"], r["service"], r["environment"], r["trace_id"]) == (1767225600500000000, 4, "User 7 at /x", "a", "prod", TRACE)
    assert json.loads(r["attributes_json"]) == {"User": 7, "Http": {"Path": "/x"}} and set(r["attr"]) == {"User", "Http", "Http.Path"}
    assert one(level="odd")["attributes_json"] == '{"severityText":"odd"}' and one(level="odd")["level"] == 3
    assert one(x=1)["ts_ns"] == NOW and one(timestamp=1700000000)["ts_ns"] == 1_700_000_000 * 10**9 and one(timestamp="1700000000123")["ts_ns"] == 1_700_000_000_123 * 10**6
    r = one(timestamp=5, **{"@t": 6})
    assert r["ts_ns"] == 5 * 10**9 and json.loads(r["attributes_json"]) == {"@t": 6}
    assert one(exception="A.B: broke\n  at c")["exception"] == {"type": "A.B", "message": "broke", "stack_trace": "A.B: broke\n  at c"}
    assert one(error={"class": "E", "message": "m"})["message"] == "m" and one(exception="no type here")["exception"]["type"] is None
    assert one(properties={"a": 1}, attributes={"b": 2}, c=3)["attributes_json"] == '{"a":1,"b":2,"c":3}'
    assert one(n=2**63, f=1.0)["attributes_json"] == '{"n":9.223372036854776e+18,"f":1.0}'


@pytest.mark.parametrize(
    "body, fmt, said",
    [
        ("", "json", "invalid JSON"), ("[]", "json", "no events"), ("[1]", "json", "event 0: expected a JSON object"), ('[{"a":1},{"timestamp":"x"}]', "json", "event 1: invalid timestamp"), ('{"properties":3}', "json", "'properties' must be an object, not int"),
        ('{"a":1}\n\n{"b"', "ndjson", "line 3:"), ('{"a":' + "[" * 33 + "]" * 33 + "}", "json", "nested more than 32"), ('{"a": NaN}', "json", "invalid JSON"), (b"\xff", "json", "UTF-8"),
    ],
)
def test_native_refusals(body, fmt, said):
    with pytest.raises(native.IngestError, match=said):
        native.parse(body, fmt, NOW)


def test_native_envelopes_and_limits():
    assert len(native.parse('{"events":[{"a":1},{"b":2}]}', "json", NOW)) == 2
    assert len(native.parse('{"events":[{"a":1}],"x":1}', "json", NOW)) == 1
    assert len(native.parse('\n{"a":1}\r\n  \n{"b":2}', "ndjson", NOW)) == 2
    for n, ok in ((2, True), (3, True), (4, False)):
        body = "\n".join('{"a":1}' for _ in range(n))
        if ok:
            assert len(native.parse(body, "ndjson", NOW, native.Limits(3))) == n
        else:
            with pytest.raises(native.TooManyEvents):
                native.parse(body, "ndjson", NOW, native.Limits(3))
    assert native.parse('{"a":' + "[" * 32 + "]" * 32 + "}", "json", NOW)
    assert native.format_of("application/x-ndjson; charset=utf-8") == "ndjson" and native.format_of(None) == "json"
    with pytest.raises(native.IngestError):
        native.format_of("text/plain")


def kv(**attrs):
    return [{"key": k.replace("__", "."), "value": v} for k, v in attrs.items()]


LOGS = {"resourceLogs": [{"resource": {"attributes": kv(service__name={"stringValue": "granary"}, host__name={"stringValue": "silo-3"})}, "scopeLogs": [{"scope": {"name": "Granary.Scale"}, "logRecords": [
    {"timeUnixNano": str(NOW), "severityNumber": 13, "severityText": "Warning", "body": {"stringValue": "Hopper 4 below mark"}, "attributes": kv(left={"intValue": "3"}, raw={"bytesValue": base64.b64encode(b"hi").decode()})},
    {"timeUnixNano": str(NOW + 1), "severityNumber": "SEVERITY_NUMBER_ERROR2", "traceId": TRACE, "attributes": kv(exception__type={"stringValue": "ScaleFault"}, exception__message={"stringValue": "no reading"})},
    {"observed_time_unix_nano": NOW, "severity_text": "odd", "body": {"kvlistValue": {"values": kv(message={"stringValue": "inner"}, n={"doubleValue": 1.5})}}},
]}]}]}
SPANS = {"resourceSpans": [{"resource": {"attributes": kv(service__name={"stringValue": s})}, "scopeSpans": [{"spans": spans}]} for s, spans in (
    ("mill", [{"traceId": TRACE, "spanId": "00000000000000a1", "name": "grind batch", "kind": 2, "startTimeUnixNano": str(NOW), "endTimeUnixNano": str(NOW + 800_000_000), "status": {"code": 2, "message": "bad"}}, {"traceId": "00", "spanId": "01", "name": "lost"}]),
    ("sieve", [{"traceId": TRACE, "spanId": "00000000000000a2", "parentSpanId": "00000000000000a1", "name": "sift", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": str(NOW + 50_000_000), "endTimeUnixNano": str(NOW + 750_000_000), "status": {"code": "STATUS_CODE_ERROR"}, "events": [{"name": "exception", "attributes": kv(a={"boolValue": True})}]},
                  {"traceId": TRACE, "spanId": "00000000000000a3", "parentSpanId": "00000000000000a2", "name": "weigh sack", "startTimeUnixNano": str(NOW + 60_000_000), "endTimeUnixNano": str(NOW + 80_000_000), "attributes": kv(sieve__mesh={"stringValue": "copper"})}]))]}
POINT = lambda t, **o: {"timeUnixNano": str(NOW + t * 10**9), **o}
METRICS = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
    {"name": "sacks.filled", "unit": "1", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [POINT(0, asInt="12", attributes=kv(door={"stringValue": "/east"})), POINT(1, asInt="18", attributes=kv(door={"stringValue": "/east"})), POINT(2, asInt="4", attributes=kv(door={"stringValue": "/west"}))]}},
    {"name": "bin.level", "gauge": {"dataPoints": [POINT(0, asDouble=1.5), POINT(1, asDouble=2.5)]}},
    {"name": "grind.time", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [POINT(0, count="4", sum=615, min=30, max=300, bucketCounts=["1", "3"], explicitBounds=[100])]}},
    {"name": "empty"},
]}]}]}


@pytest.mark.parametrize("signal, body", [("logs", LOGS), ("traces", SPANS), ("metrics", METRICS)])
def test_otlp_json_and_protobuf_agree(signal, body):
    a = otlp.decode(signal, json.dumps(body), "json", NOW)
    b = otlp.decode(signal, otlp.to_proto(signal, otlp.from_json(signal, body)), "protobuf", NOW)
    assert a == b and a.rows


def test_otlp_mapping():
    low, error, odd = otlp.decode("logs", json.dumps(LOGS), now=NOW).rows
    assert (low["level"], low["service"], low["message"]) == (4, "granary", "Hopper 4 below mark") and json.loads(low["attributes_json"]) == {"left": 3, "raw": "aGk=", "otel.scope.name": "Granary.Scale"}
    assert error["level"] == 5 and error["exception"]["type"] == "ScaleFault" and error["message"] == "no reading" and error["trace_id"] == TRACE
    assert odd["message"] == "inner" and odd["level"] == 3 and json.loads(odd["attributes_json"])["severityText"] == "odd"
    spans = otlp.decode("traces", json.dumps(SPANS), now=NOW)
    assert (spans.rejected, spans.reason, len(spans.rows)) == (1, "span without trace id or span id", 3)
    assert [r["span_kind"] for r in spans.rows] == ["Server", "Client", "Unspecified"]
    points = otlp.decode("metrics", json.dumps(METRICS), now=NOW)
    assert points.rejected == 1 and len(points.rows) == 6 and points.rows[5]["hist"]["count"] == 4 and points.rows[0]["monotonic"]
    for bad in ('{"resourceLogs":3}', "[", '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"x"}]}]}]}'):
        with pytest.raises(native.IngestError, match="invalid OTLP payload"):
            otlp.decode("logs", bad)
    for bad in (b"\x0a\x05abc", b"\x0f", b"\x80" * 12):
        with pytest.raises(native.IngestError):
            otlp.decode("logs", bad, "protobuf")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    for signal, body in (("logs", LOGS), ("traces", SPANS), ("metrics", METRICS)):
        s.ingest(signal, otlp.decode_frame(spark.createDataFrame([(json.dumps(body),)], "body string"), signal, now=NOW))
    lines = [{"timestamp": f"2026-01-01T00:{i:02d}:00Z", "message": f"m{i:02d}", "level": "Error" if i % 7 == 0 else "Debug", "service": "paging", "n": i, "tags": ["a", "b"] if i % 2 else ["a"], "mixed": i if i % 3 else str(i)} for i in range(25)]
    bodies = spark.createDataFrame([("\n".join(map(json.dumps, lines[k : k + 5])),) for k in range(0, 25, 5)], "body string").repartition(3)
    s.ingest("logs", native.parse_frame(bodies, "ndjson", NOW))
    return s


@pytest.fixture(scope="module")
def engine(store):
    return Engine(store)


def test_counts_names_and_ids(store, engine):
    assert [engine.count(s) for s in ("logs", "traces", "metrics")] == [28, 3, 6]
    assert engine.metric_names() == (["bin.level", "grind.time", "sacks.filled"], False) and engine.metric_names(2) == (["bin.level", "grind.time"], True)
    ids = [r.id for r in store["logs"].view().df.select("id").collect()]
    assert sorted(ids) == list(range(1, 29))
    assert {"fields", "files_skipped"} <= set(vars(engine.last))
    with pytest.raises(limits.UnknownSignal):
        store["nope"]


def test_search_pages_both_ways(engine):
    def walk(forward):
        got, cursor = [], None
        while True:
            p = engine.events("logs", "service = paging", limit=10, cursor=cursor, forward=forward)
            got += [r.message for r in p.rows]
            if not (cursor := p.next):
                return got

    names = [f"m{i:02d}" for i in range(25)]
    assert walk(True) == names and walk(False) == names[::-1]
    p = engine.events("logs", "service = paging", "2026-01-01T00:05:00Z", "2026-01-01T00:08:00Z", forward=True)
    assert [r.message for r in p.rows] == ["m05", "m06", "m07"] and p.next is None
    assert engine.events("logs", "", "2020-01-01T00:00:00Z", "2020-01-02T00:00:00Z").rows == []
    for bad in ({"limit": 0}, {"limit": 1001}, {"cursor": "v2.1.1"}, {"start": "soon"}, {"start": "now", "stop": "-1h"}):
        with pytest.raises((QueryError, ValueError)):
            engine.events("logs", **bad)
    c = search.Cursor(-5, 7)
    assert search.Cursor.decode(c.encode()) == c and c.encode() == "v1.fffffffffffffffb.7"


def test_histogram(engine):
    h = engine.histogram("logs", "service = paging", "2026-01-01T00:00:00Z", "2026-01-01T00:30:00Z", 30)
    assert h["stepMs"] == 60_000 and h["total"] == 25 and len(h["buckets"]) == 30
    assert h["buckets"][7].levels == [0, 0, 0, 0, 0, 1, 0] and h["buckets"][25]["count"] == 0
    assert engine.count("logs", "service = paging", "2026-01-01T00:10:00Z") == 15
    assert [series.choose_step_ms(0, ms * 10**6, 60) for ms in (1, 60_000, 3_600_000, 86_400_000, 10**11, 10**12)] == [1000, 1000, 60_000, 1_800_000, 1_666_666_666 // 86_400_000 * 86_400_000 + 86_400_000, 10**12 // 60 // 86_400_000 * 86_400_000 + 86_400_000]
    with pytest.raises(limits.ResultLimit):
        series.check_points(0, 10**13 + 1, 1)
    series.check_points(0, 10**4 * 10**6, 1)


def test_facets(engine, store):
    f = engine.facets("logs", "service = paging")
    names = [x["field"] for x in f["fields"]]
    assert f["sampled"] == 25 and names[:2] == ["level", "service"] and set(names[2:]) == {"n", "tags", "mixed"}
    tags = next(x for x in f["fields"] if x["field"] == "tags")
    assert tags["count"] == 25 and tags["values"] == [{"value": "a", "count": 25}, {"value": "b", "count": 12}]
    n = next(x for x in f["fields"] if x["field"] == "n")
    assert n["truncated"] and len(n["values"]) == 10
    assert [x["field"] for x in engine.facets("logs", "", fields=["level", "tags"])["fields"]] == ["level", "tags"] and engine.facets("logs", "", fields=[])["fields"] == []
    with pytest.raises(QueryError):
        facets(store["logs"].view(), only=[str(i) for i in range(65)])


def test_metrics(engine):
    ask = lambda name, **k: engine.metric(name, start=NOW - 10**9, stop=NOW + 10**10, step_ms=60_000, **k)
    last = lambda m: {g: [v for _, v in p if v is not None] for g, p in m["series"].items()}
    assert last(ask("sacks.filled", agg="sum")) == {None: [34.0]} and last(ask("sacks.filled", agg="count")) == {None: [3.0]}
    m = ask("sacks.filled", agg="max", group_by="door")
    assert last(m) == {"/east": [18.0], "/west": [4.0]} and m["meta"] == {"unit": "1", "kind": "sum", "description": None}
    assert last(ask("sacks.filled", query='door = "/west"', agg="sum")) == {None: [4.0]}
    assert last(ask("grind.time")) == {None: [153.75]} and last(ask("grind.time", agg="max")) == {None: [300.0]} and last(ask("grind.time", agg="last")) == {None: [153.75]}
    assert last(ask("bin.level", agg="last", group_by="x")) == {"(none)": [2.5]}
    assert ask("absent")["series"] == {}
    with pytest.raises(QueryError):
        ask(" ")


def test_traces(engine):
    (t,) = engine.traces("status = Error")
    assert (t.trace_id, t.root_name, t.root_service, t.span_count, t.error_count, t.services, t.truncated) == (TRACE, "grind batch", "mill", 3, 2, ["mill", "sieve"], False) and abs(t.duration_ms - 800) < 1
    assert len(engine.traces("durationMs > 600 and service = sieve")) == 1 and engine.traces("durationMs > 5000") == []
    spans = engine.trace(TRACE.upper())
    assert [s.message for s in spans] == ["grind batch", "sift", "weigh sack"] and spans[0].parent_span_id is None and engine.trace("dead") == []
    assert [r.message for r in engine.events("traces", 'sieve.mesh = "copper"').rows] == ["weigh sack"]
    assert [r.message for r in engine.events("logs", f"traceId = '{TRACE}'").rows] == ["no reading"]
    with pytest.raises(limits.ResultLimit):
        traces.trace(engine.store["traces"].view(), TRACE, most=2)
    assert len(traces.trace(engine.store["traces"].view(), TRACE, most=3)) == 3


def test_orphans_and_caps(spark):
    rows = [("t", "b", "a", 5, 1, 10, "orphan", "x", "Ok"), ("t", "c", "b", 3, 2, 100, "child", "y", "Error"), ("t", "d", None, 5, 3, 1, "late root", None, "Unset"), ("u", None, "q", 1, 4, 1, "alone", "z", "Error")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent string, ts long, id long, duration_ns long, name string, service string, status string")
    got = {r.trace_id: r for r in traces.summarize(df).collect()}
    assert got["t"].root_name == "orphan" and got["t"].start == 3 and got["t"].duration_ms == 100 / 1e6 and got["t"].services == ["x", "y"] and got["u"].root_name == "alone"
    two = {r.trace_id: r for r in traces.summarize(df, 2).collect()}
    assert two["t"].truncated and two["t"].span_count == 2 and not two["u"].truncated


def test_panels_and_stats(engine, store, spark):
    assert engine.panel("single_stat", {"query": "level = Error"}, "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z") == 5
    assert engine.panel("single_stat", {"metric": "sacks.filled", "agg": "sum"}, NOW - 10**9, NOW + 10**10) == 34
    assert len(engine.panel("saved_query", {"query": "service = paging"})) == 10 and engine.panel("log_count", {}, NOW - 10**9, NOW + 10**9)["total"] == 3
    rows = {(r.signal, r.field): r for r in engine.stats.frame(spark).collect()}
    assert rows["logs", "service"].queries >= 2
    s = {x["signal"]: x for x in store.stats()}
    assert s["logs"]["events"] == 28 and s["logs"]["compressionRatio"] > 0
    p = {r.path: r for r in property_stats(store["logs"].view().df).collect()}
    assert p["n"].present == 25 and p["n"].max == 24 and p["mixed"].kinds == ["int", "string"]


def test_event_json(store):
    v = store["logs"].view()
    got = [json.loads(r[0]) for r in v.df.where("message = 'no reading'").select(event_json(v)).collect()]
    assert got[0]["level"] == "Error" and got[0]["exception"] == {"type": "ScaleFault", "message": "no reading"} and got[0]["resource"]["host.name"] == "silo-3" and "environment" not in got[0]
    t = store["traces"].view()
    span = json.loads(t.df.where("message = 'sift'").select(event_json(t)).first()[0])
    assert span["durationNanos"] == 700_000_000 and span["status"] == {"code": "Error"} and span["spanKind"] == "Client"


def test_table_maintenance(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}")["logs"]
    day = 86_400 * 10**9

    def rows(at, n=3):
        return native.parse_frame(spark.createDataFrame([(json.dumps({"timestamp": at // 10**6 + i, "i": i}),) for i in range(n)], "b string").coalesce(1), "json", NOW)

    for k in range(5):
        t.append(rows(NOW + k * 10**9), f"b{k}")
    assert t.append(rows(NOW), "b2").next_id == 16 and len(t.manifest().files) == 5
    before = sorted((r.id, r.ts_ns) for r in t.view().df.collect())
    best, diag = t.latest(parse("i = 2"), limit=1)
    assert best[0].id == 15 and diag.files_read == 1 and diag.files_skipped == 4
    assert [r.id for r in t.latest(limit=4, cursor=search.Cursor(best[0].ts_ns, 15))[0]] == [14, 13, 12, 11]
    d = t.diagnose(NOW, NOW + 2 * 10**9)
    assert (d.files_considered, d.files_skipped) == (5, 3)
    assert t.compact() == 5 and len(t.manifest().files) == 1 and sorted((r.id, r.ts_ns) for r in t.view().df.collect()) == before
    assert t.vacuum() == 5 and t.view().df.count() == 15
    t.append(rows(NOW - 40 * day))
    assert t.expire(NOW) == 1 and t.view().df.count() == 15 and t.expire(NOW) == 0
    m = t.manifest()
    t._commit(m)
    with pytest.raises(Conflict):
        t._commit(m)
    with pytest.raises(limits.TooExpensive):
        t.view(budget=limits.Budget(bytes=sum(f.bytes for f in m.files) - 1))
    t.view(budget=limits.Budget(bytes=sum(f.bytes for f in m.files)))
    assert t.append(rows(NOW, 1)).next_id == 20


def test_budget_time_and_cancel(spark):
    from pyspark.sql import functions as F

    slow = spark.range(4).repartition(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 4000L)"))
    with pytest.raises(limits.QueryTimeout):
        with limits.Budget(time_ms=300).running(spark):
            slow.collect()
    token = limits.CancelToken()
    threading.Timer(0.5, token.cancel).start()
    with pytest.raises(limits.Cancelled):
        with limits.Budget(token=token).running(spark):
            slow.collect()
    gate = limits.Admission(1, 50)
    with gate.slot(), pytest.raises(limits.Busy):
        with gate.slot():
            pass


def test_ingest_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}/store")["logs"]
    source = tmp_path / "in"
    source.mkdir()

    def run():
        bodies = spark.readStream.schema("value string").text(str(source))
        live.ingest_stream(bodies, lambda b: native.parse_frame(b, "ndjson", NOW), t, str(tmp_path / "cp")).awaitTermination()

    (source / "a.ndjson").write_text('{"i":1}\n{"i":2}\n')
    run()
    (source / "b.ndjson").write_text('{"i":3}\n')
    run()
    run()
    assert sorted(r[0] for r in t.view().df.selectExpr("attributes_json").collect()) == ['{"i":1}', '{"i":2}', '{"i":3}'] and t.manifest().next_id == 4


def test_tail(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tracewell.sources import schema

    data = str(tmp_path / "t")
    native.parse_frame(spark.createDataFrame([(json.dumps({"timestamp": i + 1, "level": "Error" if i % 2 else "Debug", "i": i}),) for i in range(9)], "b string"), "json", NOW).selectExpr("monotonically_increasing_id() as id", "*").coalesce(1).write.parquet(data)
    stream = spark.readStream.schema(StructType.fromDDL("id long, " + schema.columns("logs"))).parquet(data)
    got = []
    t = live.tail(View.stored("logs", stream), lambda rows, over: got.append(([r.ts_ns // 10**9 for r in rows], over)), "level = Error or i = 4", most=3)
    t.query.awaitTermination()
    t.close()
    assert got == [([2, 4, 5], 2)] and t.dropped == 2


def test_alert_stream(spark, tmp_path):
    data = str(tmp_path / "e")
    spark.sql("select timestamp_seconds(id) as ts, id * 1000000000L as ts_ns, id, cast(if(id % 3 = 0, 5, 2) as tinyint) as level from range(600)").write.parquet(data)
    stream = spark.readStream.schema("ts timestamp, ts_ns long, id long, level tinyint").parquet(data)
    a = alerts.Alert("many", "level = Error", ">=", 20, window_secs=60, interval_secs=60)
    out = live.alert_stream(View.stored("logs", stream), a)
    q = out.writeStream.outputMode("complete").format("memory").queryName("alert_windows").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select * from alert_windows").collect()
    assert len(rows) == 10 and {r.status for r in rows} == {"FIRING"} and {r.value for r in rows} == {20.0}


def test_alerts(spark, store):
    view = store["logs"].view()
    at = parse_rfc3339("2026-01-01T00:24:00Z")
    a = alerts.Alert("errors", "level = Error", ">", 3, window_secs=3600, interval_secs=60, webhook_url="http://h/")
    sent = []
    m = alerts.Monitor([a, alerts.Alert("broken", "level =", ">", 1), alerts.Alert("off", "", ">", 1, enabled=False)], lambda url, body: sent.append((url, body["to"])))
    assert [(x.name, e.status, e.value) for x, e in m.tick({"logs": view}, at)] == [("errors", "FIRING", 4.0), ("broken", "ERROR", None)]
    assert m.tick({"logs": view}, at + 30 * 10**9) == [] and m.tick({"logs": view}, at + 61 * 10**9)[0][1].status == "FIRING"
    m.tick({"logs": view}, at + 7200 * 10**9)
    assert [(h["alert"], h["from"], h["to"]) for h in m.history] == [("errors", "OK", "FIRING"), ("broken", "OK", "ERROR"), ("errors", "FIRING", "OK")] and sent == [("http://h/", "FIRING"), ("http://h/", "OK")]
    for bad in ({"name": " "}, {"op": "~"}, {"threshold": float("nan")}, {"window_secs": 0}, {"interval_secs": 9}, {"webhook_url": "ftp://x"}, {"query": "a ="}):
        with pytest.raises(QueryError):
            alerts.Alert(**({"name": "n", "query": "", "op": ">", "threshold": 1.0} | bad)).validate()
    calls = []
    post = lambda codes: lambda url, body: calls.append(1) or codes[len(calls) - 1]
    for codes, ok, n in (([500, 429, 200], True, 3), ([404], False, 1), ([500, 500, 500], False, 3)):
        calls.clear()
        assert alerts.send_webhook("http://h/", {}, post(codes), lambda s: None) is ok and len(calls) == n
    assert alerts.holds(1, "!=", 2) and not alerts.holds(1, "??", 1)


def test_gzip_and_whole_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.ndjson.gz").write_bytes(gzip.compress(b'{"i":1}\n{"i":2}\n'))
    (tmp_path / "b.json").write_text('[{"i":3},\n{"i":4}]')
    got = native.read_files(spark, str(tmp_path / "a.ndjson.gz"), now=NOW).union(native.read_files(spark, str(tmp_path / "b.json"), "json", now=NOW))
    assert sorted(r[0] for r in got.select("attributes_json").collect()) == [f'{{"i":{i}}}' for i in range(1, 5)]
    bad = spark.createDataFrame([("{",), ('{"i":5}',), (None,)], "body string")
    assert native.parse_frame(bad, "json", NOW, on_error="skip").count() == 1
    with pytest.raises(Exception, match="invalid JSON"):
        native.parse_frame(bad, "json", NOW).count()


def test_partial_success(spark):
    bodies = spark.createDataFrame([(json.dumps(SPANS),), ("[",), (json.dumps(METRICS),)], "body string")
    got = [tuple(r) for r in otlp.rejections(bodies, "traces").collect()]
    assert got[0] == (3, 1, "span without trace id or span id", None) and got[1][3].startswith("invalid OTLP payload") and got[2] == (0, 0, None, None)


def test_writers_that_come_second_try_again(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}")["logs"] for _ in range(2))
    bodies = lambda k: native.parse_frame(spark.createDataFrame([(json.dumps({"i": k}),)] * 3, "b string").coalesce(1), "json", NOW)
    publish, calls = one._publish, []

    def late(folder, version, value):
        if not calls:  # another writer is first, once
            calls.append(1)
            two.append(bodies(2), "other#0")
        publish(folder, version, value)

    one._publish = late
    one.append(bodies(1), "own#0")
    rows = {r.id: r.attributes_json for r in two.view().df.collect()}
    assert rows == {1: '{"i":2}', 2: '{"i":2}', 3: '{"i":2}', 4: '{"i":1}', 5: '{"i":1}', 6: '{"i":1}'} and one.manifest().streams == {"other": 0, "own": 0}
    assert len(one._names("data")) == 2 and one._names("staging") == []
    assert one.append(bodies(3), "own#0").next_id == 7
    one._publish = lambda *a: (_ for _ in ()).throw(Conflict("always"))
    with pytest.raises(Conflict):
        one.append(bodies(4))
    assert len(one._names("data")) == 2 and one._names("staging") == [] and one.vacuum(orphan_hours=0) == 0


def test_inbox_commits_together_and_refuses_what_is_over(spark, tmp_path):
    table = Store(spark, f"file://{tmp_path}")["logs"]
    box = live.Inbox(table, most=3)
    box.submit(native.events_of('[{"i":1},{"i":2}]', "json", NOW))
    with pytest.raises(limits.Busy):
        box.submit(native.events_of('[{"i":3},{"i":4}]', "json", NOW))
    assert box.submit(native.events_of('{"i":5}', "json", NOW)) == 3
    version = box.flush().version
    assert sorted(r[0] for r in table.view().df.select("attributes_json").collect()) == ['{"i":1}', '{"i":2}', '{"i":5}'] and box.flush().version == version
    with pytest.raises(ValueError):
        live.ingest_stream(spark.readStream.format("rate").load(), lambda b: b, table, "")
