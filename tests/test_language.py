"""The filter language: text, trees, and predicates against the plain evaluator."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions import times, values, vocab
from tracewell.plans import edit
from tracewell.plans.ast import And, Comparison, Not, Or
from tracewell.plans.compiler import flag, matching
from tracewell.plans.evaluator import matches
from tracewell.plans.parser import ParseError, parse
from tracewell.plans.view import View, resolve
from tracewell.sources.columns import as_row
from tracewell.sources import schema


@pytest.mark.parametrize(
    "text, shown",
    [
        ("", None),
        ("  \n", None),
        ("level = Error", 'level = "Error"'),
        ("a = 1 and b = 2 or c = 3", "a = 1 and b = 2 or c = 3"),
        ("a = 1 and (b = 2 or c = 3)", "a = 1 and (b = 2 or c = 3)"),
        ("a==1 && b<>2 || NOT c>=3.5", "a = 1 and b != 2 or not c >= 3.5"),
        ("not (a = 1 and b = 2)", "not (a = 1 and b = 2)"),
        ("'it\\'s' ", 'message contains "it\'s"'),
        ('x contains "a\\"b\\\\c\\n"', 'x contains "a\\"b\\\\c\\n"'),
        ("a = -5 and b = 1e3 and c = 99999999999999999999", "a = -5 and b = 1000.0 and c = 1e20"),
        ("@t > '2026-01-01T00:00:00Z' and http.status-code = TRUE", '@t > "2026-01-01T00:00:00Z" and http.status-code = true'),
        ("a = 1 or (b = 2 or c = 3)", "a = 1 or (b = 2 or c = 3)"),
    ],
)
def test_text_and_back(text, shown):
    e = parse(text)
    assert (None if e is None else str(e)) == shown
    assert shown is None or parse(shown) == e


@pytest.mark.parametrize(
    "text, message, position",
    [
        ("level =", "Expected a value after '=' but found end of query", 7),
        ("level", "Expected an operator after 'level' but found end of query", 5),
        ("= 1", "Expected a field, string or '(' but found '='", 0),
        ("a = 1 b = 2", "Expected 'and' or 'or' before field 'b'", 6),
        ("a = 1)", "Unexpected ')' without matching '('", 5),
        ("(a = 1", "Expected ')' but found end of query", 6),
        ("()", "Empty parentheses", 1),
        ("a = 1 and", "Expected expression after 'and'", 9),
        ("not", "Expected expression after 'not'", 3),
        ("a = 'x", "Unterminated string", 4),
        ("a ! 1", "Expected '=' after '!'", 2),
        ("a = 5m", "Invalid number '5m'", 4),
        ("a = 1.", "Invalid number '1.'", 4),
        ("a = 1e999", "Invalid number '1e999'", 4),
        ("a. = 1", "Field name 'a.' cannot end with '.'", 0),
        ("é = 1 # x", "Unexpected character '#'", 7),
        ("a contains null", "'contains' needs a text value", 11),
        ("a = 1 = 2", "Unexpected '='", 6),
        ("a = 1 | b = 2", "Unexpected character '|'", 6),
    ],
)
def test_errors(text, message, position):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (e.value.message, e.value.position) == (message, position)


def test_depth():
    assert parse("(" * 63 + "a = 1" + ")" * 63) == Comparison("a", "=", 1)
    assert parse("not " * 63 + "a = 1")
    for text in ("(" * 64 + "a = 1" + ")" * 64, "not " * 64 + "a = 1"):
        with pytest.raises(ParseError, match="nested too deeply"):
            parse(text)
    assert parse(" or ".join(f"a = {i}" for i in range(300)))


LITERALS = st.one_of(st.text(max_size=8), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False, allow_infinity=False), st.booleans(), st.none())
NAMES = st.from_regex(r"[a-zA-Z_@][a-zA-Z0-9_@]{0,6}", fullmatch=True).filter(lambda n: n.lower() not in ("and", "or", "not", "contains", "true", "false", "null"))
LEAVES = st.builds(Comparison, NAMES, st.sampled_from(["=", "!=", ">", ">=", "<", "<="]), LITERALS)
TREES = st.recursive(LEAVES, lambda c: st.one_of(st.builds(And, c, c), st.builds(Or, c, c), st.builds(Not, c)), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_every_tree_round_trips(tree):
    assert parse(str(tree)) == tree


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.=!<>()'\"\\ &|-@é\nnotrd", max_size=24))
def test_parser_only_fails_with_its_own_error(text):
    try:
        parse(text)
    except ParseError as e:
        assert 0 <= e.position <= len(text.encode())


EVENT = {
    "id": 1, "ts_ns": 1_700_000_000_000_000_500, "observed_ns": 0, "level": 4, "service": "depot", "environment": "lab", "trace_id": "0f3c", "span_id": None,
    "message": "Crane 7 is stuck at gate B", "message_template": "Crane {n} is stuck at {where}", "exception": {"type": "Jam", "message": None, "stack_trace": "in lift()"},
    "attributes": {"crane": 7, "load": 12.25, "gate": "B", "serial": "0042", "on": " True ", "marks": ["red", "old", 3], "geo": {"lat": 48, "x.y": {"z": 9}}, "gone": None, "huge": 2**60 + 1, "hugeText": str(2**60 + 1), "whole": 2.0, "zero": "-0", "deep": [[4, "q"], {"w": 1}], "empty": {}},
    "resource": {"rack.id": "r-9", "crane": 70, "gone": "hidden", "site": "north"},
}

#: One line per rule of the language: what holds of EVENT, and what doesn't.
HOLDS = """
level = Warning; level = wrn; level >= notice; level <= Error; level != nonsense; level != 4; level contains 'ARN'; level != null
service = depot; service contains EPO; env != prod; environment > 'a' and environment < 'm'; service != Depot
traceId = '0F3C'; traceId = ' 0f3c '; spanId = null; spanId != y; traceId > '0e'; traceId contains F3
crane = 7; crane = '7'; crane = '7.00'; resource.crane = 70; attributes.crane < 8; crane contains 7; properties.crane != 70
load > 12 and load <= 12.25; load contains '12.25'; whole contains '2.0'; serial = 42; serial > 5; serial > '5'; serial < 'z'; on = true; on != false; gate != 'b'
marks = red; marks != blue; marks contains LD; marks > 2; marks = 3; geo.lat = 48; geo.x.y.z = 9; geo != null
gone = null; gone != 5; site = north; rack.id = r-9; missing = null; missing != x; not missing > 1; not missing = x
huge = 1152921504606846977; hugeText = 1152921504606846977; zero = 0; deep = q; deep = 4
timestamp > '2023-11-14T22:13:19Z'; timestamp < 1700000001; timestamp != null; timestamp != rubbish; timestamp contains '22:13:20.000000500z'
exception.type = Jam; exception contains 'IN LIFT'; exception.message = null; @mt contains '{WHERE}'; 'STUCK at'; message contains ''
level = wrn and service = depot; not (level = wrn and service = x); level = Debug or not missing = 1
"""
FAILS = """
level = nonsense; level > 2; level = null; level < info; service = Depot; spanId = y; spanId != null; traceId < '0e'
crane = 70; crane contains 8; load > 13; load = true; load < true; on = 'true'; gate = 'b'; gate > 1; serial < 42
marks != red; marks = blue; geo = 'x'; geo contains l; empty = null; gone = hidden; missing > 1; missing contains ''; deep = 1; deep = w
huge = 1152921504606846976; hugeText = 1152921504606846976; timestamp = null; timestamp = rubbish; 'stuck here'; level = Debug and service = depot
"""
CASES = {q.strip(): held for text, held in ((HOLDS, True), (FAILS, False)) for line in text.strip().splitlines() for q in line.split("; ")}


def frame(spark, events):
    from pyspark.sql.types import StructType

    rows = []
    for e in events:
        e = dict(e)
        row = as_row(e.pop("attributes"), e.pop("resource"), **e)
        rows.append(row)
    return spark.createDataFrame(rows, StructType.fromDDL("id long, " + schema.columns("logs")))


def test_one_rich_event(spark):
    assert {q: matches(parse(q), EVENT) for q in CASES} == CASES
    v = View.stored("logs", frame(spark, [EVENT]))
    got = v.df.select(*(flag(parse(q), v).alias(f"c{i}") for i, q in enumerate(CASES))).first()
    assert dict(zip(CASES, got)) == CASES
    upside = v.df.select(*(flag(Not(parse(q)), v).alias(f"c{i}") for i, q in enumerate(CASES))).first()
    assert dict(zip(CASES, upside)) == {q: not r for q, r in CASES.items()}


def messy(rng, i):
    props = {}
    if rng.random() < 0.8:
        props["customerId"] = rng.choice([rng.randint(0, 9), str(rng.randint(0, 9)), rng.randint(0, 9) + 0.5, f"c{rng.randint(0, 9)}", None, True])
    if rng.random() < 0.8:
        props["durationMs"] = rng.choice([rng.randint(0, 300), str(rng.randint(0, 300)), f" {rng.randint(0, 9)} ", "1e2", "12d", "inf"])
    code = rng.choice([200, 500, "404", "ok"])
    props |= rng.choice([{}, {"http": {"statusCode": code}}, {"http.statusCode": code}, {"http": "flat"}])
    if rng.random() < 0.6:
        props["tags"] = rng.sample(["blue", 7, "7", True, None, [1, "x"], {"k": 1}, 2.5], rng.randint(0, 4))
    if rng.random() < 0.6:
        props["flag"] = rng.choice([True, False, "true", " FALSE ", None, "yes"])
    res = {"region": rng.choice(["eu", "us", 1])} if rng.random() < 0.5 else {}
    if rng.random() < 0.3:
        res["customerId"] = rng.randint(0, 9)
    return {
        "id": i, "ts_ns": 1_760_000_000_000_000_000 + rng.randint(0, 10**12), "observed_ns": 0, "level": rng.choice([1, 2, 3, 4, 5, 6, 0, None]), "service": rng.choice(["orders", "123", None, "Ünï"]), "environment": rng.choice(["prod", None]),
        "trace_id": rng.choice([None, "ab12", "zz-9"]), "span_id": None, "message": rng.choice(["Timed OUT", "42", "", "é É"]), "message_template": None, "exception": rng.choice([None, {"type": "T", "message": None, "stack_trace": None}]), "attributes": props, "resource": res,
    }


def test_compiled_predicates_are_the_evaluator(spark):
    import random

    rng = random.Random(11)
    events = [messy(rng, i) for i in range(120)]
    fields = ["customerId", "durationMs", "http.statusCode", "tags", "flag", "region", "level", "service", "environment", "message", "traceId", "timestamp", "exception.type", "resource.customerId", "attributes.flag", "absent", "http"]
    lits = ["Error", "warn", 5, 7, "7", 2.5, "100", True, False, None, "", "blue", "x", "true", "AB12", "orders", "eu", 1, "2025-10-09T09:00:00Z", 1760000400, "c3", -1, "404", "é"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            op = rng.choice(["=", "!=", ">", ">=", "<", "<=", "contains"])
            lit = rng.choice(lits)
            return Comparison(rng.choice(fields), op, "e" if op == "contains" and lit is None else lit)
        k = rng.random()
        return Not(tree(depth - 1)) if k < 0.3 else (And if k < 0.65 else Or)(tree(depth - 1), tree(depth - 1))

    trees = [tree(rng.randint(0, 3)) for _ in range(240)]
    v = View.stored("logs", frame(spark, events).cache())
    some = 0
    for at in range(0, len(trees), 40):
        part = trees[at : at + 40]
        rows = v.df.select("id", *(flag(t, v).alias(f"c{i}") for i, t in enumerate(part))).collect()
        for r in rows:
            for i, t in enumerate(part):
                assert r[f"c{i}"] == matches(t, events[r.id]), (str(t), events[r.id])
                some += r[f"c{i}"]
    assert 5000 < some < 25_000
    for t in trees[:15]:
        assert {r.id for r in matching(v, t).select("id").collect()} == {e["id"] for e in events if matches(t, e)}


def test_filters_reach_parquet(spark):
    from tracewell.sources import views

    v = views.logs(spark, "/root/testdata/sf0.001")
    plan = matching(v, parse("value > 100 and not userId = 7"), 1_704_400_000_000_000_000)._jdf.queryExecution().toString()
    assert "GreaterThan(value,100.0)" in plan and "Or(IsNull(user_id),Not(EqualTo(user_id,7)))" in plan and "GreaterThanOrEqual(ts," in plan


def test_values():
    f = {"a.b": 1, "a": {"b": 2, "c": {"d": 3}, "c.d": 4}, "x": {"y.z": 5}, "x.y": {"z": 6}, "l": [{"p": 1}, [2, 3]]}
    assert [values.lookup(f, p) for p in ("a.b", "a.c.d", "x.y.z", "a.c", "nope", "l.p")] == [1, 4, 5, {"d": 3}, None, None]
    for p, v in values.paths(f).items():
        assert values.lookup(f, p) == v
    assert list(values.leaves(f))[-3:] == [("l.p", 1), ("l", 2), ("l", 3)]
    assert [values.canonical(x) for x in ("12", " 1e2 ", "12d", "nan", "inf", True, 2.0, -0.0, 2**70, "9" * 30)] == [12, 100, None, None, None, None, 2, 0, float(2**70), 1e30]
    assert [values.format_float(x) for x in (1.0, 1e15, 0.0001, 1e-7, 71.5, 1e21)] == ["1.0", "1000000000000000", "0.0001", "0.0000001", "71.5", "1000000000000000000000"]


def test_times():
    assert times.parse_rfc3339("2026-10-06T10:20:13.485Z") == 1791282013485000000
    assert times.parse_rfc3339("2026-10-06T12:20:13+02:00") == times.parse_rfc3339("2026-10-06T10:20:13Z")
    assert [times.parse_rfc3339(x) for x in ("yesterday", "2026-10-06", "2026-10-06T10:20:13", "2026-13-01T00:00:00Z")] == [None] * 4
    for ns in (0, 1, -1, 1_500, 1_760_000_000_123_456_789, -(10**18)):
        assert times.parse_rfc3339(times.format_rfc3339(ns)) == ns
    assert [times.from_unix(x) for x in (1, 10**11, 10**14, 10**17, 1.5)] == [10**9, 10**17, 10**17, 10**17, 1_500_000_000]
    assert times.parse_duration_ms("1h30m") == 5_400_000 and times.parse_duration_ms("5 parsecs") is None and times.parse_bytes("64 MiB") == 64 << 20
    now = 10**18
    assert [times.parse_api_time(x, "from", now) for x in ("now", "-15m", "now-1h", None)] == [now, now - 900 * 10**9, now - 3600 * 10**9, None]
    assert times.time_range(None, None, now, 3_600_000) == (now + 1 - 3600 * 10**9, now + 1)
    with pytest.raises(times.TimeInputError):
        times.time_range("now", "-1m", now)


def test_names_and_ids():
    assert resolve("Service.Name", "logs").name == "service" and resolve("level", "traces").space == "any" and resolve("NAME", "metrics").name == "message"
    assert resolve("Attributes.x", "logs").space == "any" and resolve("properties.level", "logs").space == "attributes"
    assert [vocab.normalise_id(x) for x in ("ABC", "Req-1", "000", "", None, " a0 ")] == ["abc", "Req-1", None, None, None, "a0"]
    assert vocab.level_code(" CRIT ") == 6 and vocab.level_from_severity(13) == 4 and vocab.level_from_severity(25) is None
    assert vocab.render_template("{{x}} {Name} {@O} {$N:f} {M,3} {gone} {open", {"Name": "n", "O": {"a": 1}, "N": 2.0, "M": None}) == '{x} n {"a":1} 2.0 null {gone} {open'


def test_edits():
    assert edit.clause("a.b", "x") == 'a.b = "x"' and edit.clause("and", 1) is None and edit.clause("a", 1, True) == "a != 1"
    assert edit.and_query("a = 1 or b = 2", "c = 3") == "(a = 1 or b = 2) and c = 3" and edit.and_query("a = 1", "a = 1") == "a = 1" and edit.and_query("", "x = 1") == "x = 1"
    assert edit.and_parts("a = 1 and b > 2") == ["a = 1", "b > 2"] and edit.and_parts("a = 1 or b = 2") is None and edit.and_parts("(a = 1)") is None
    assert edit.set_field_filter("a = 1 and b = 2", "a", "z") == 'b = 2 and a = "z"' and edit.set_field_filter("a = 1", "a", None) == "" and edit.is_filter_active("a = 1", "a", 1)
    assert edit.range_window("1h", 10**15) == (10**15 - 3600 * 10**9, 10**15 + 1) and edit.range_window("all", 5) == (None, None)
