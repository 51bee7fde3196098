"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.times import parse_rfc3339
from tracewell.functions.vocab import LEVEL_NAMES, level_code_col, level_name_col, normalise_id_col
from tracewell.operators import alerts, facets, search, series, traces
from tracewell.plans.compiler import flag, matching, rfc3339_col
from tracewell.plans.parser import parse
from tracewell.plans.view import View
from tracewell.sources import views
from tracewell.sources.scratch import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOGS = """logs AS (SELECT event_id AS id, ts, epoch_ns(ts) AS ts_ns,
  CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS level,
  'svc-' || (user_id % 8) AS service, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'staging' ELSE 'production' END AS environment,
  event_type || ' by user ' || user_id AS message, lpad(lower(to_hex(event_id % 1000 + 1)), 32, '0') AS trace_id, user_id, value, event_type,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k, [event_type, 'u' || (user_id % 3)] AS tags FROM events)"""
SPANS = """spans AS (SELECT (o_orderkey + 1) * 100 AS id, lpad(lower(to_hex(o_orderkey + 1)), 32, '0') AS trace_id, lpad(lower(to_hex((o_orderkey + 1) * 100)), 16, '0') AS span_id,
  NULL AS parent_span_id, epoch_ns(CAST(o_orderdate AS TIMESTAMP)) AS ts_ns, o_orderpriority AS name, 'shop-' || (o_custkey % 4) AS service,
  CAST(floor(CAST(o_totalprice AS DOUBLE) * 1000) AS BIGINT) AS duration_ns, 'Unset' AS status FROM orders
  UNION ALL SELECT (l_orderkey + 1) * 100 + l_linenumber, lpad(lower(to_hex(l_orderkey + 1)), 32, '0'), lpad(lower(to_hex((l_orderkey + 1) * 100 + l_linenumber)), 16, '0'),
  lpad(lower(to_hex((l_orderkey + 1) * 100)), 16, '0'), epoch_ns(CAST(l_shipdate AS TIMESTAMP)), 'ship', 'supp-' || (l_suppkey % 10),
  CAST(CAST(l_quantity AS DOUBLE) * 1000000 AS BIGINT), CASE l_returnflag WHEN 'R' THEN 'Error' WHEN 'A' THEN 'Ok' ELSE 'Unset' END FROM lineitem)"""
METRICS = "metrics AS (SELECT event_id AS id, epoch_ns(ts) AS ts_ns, 'events.' || event_type AS name, value, user_id FROM events)"
ROW = ("id", "ts_ns", "level", "service", "environment", "message")
FROM, TO = "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z"
FROM_NS, TO_NS = parse_rfc3339(FROM), parse_rfc3339(TO)
NOW_NS = parse_rfc3339("2024-01-20T12:00:00Z")


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _filter(name: str, text: str, where: str, view: Callable = views.logs, cols: tuple = ROW, cte: str = LOGS, table: str = "logs") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = view(spark, sf_dir)
        return matching(v, parse(text)).select(*cols)

    QUERIES[name] = run
    SQL[name] = f"WITH {cte} SELECT {', '.join(cols)} FROM {table} WHERE {where}"


_filter("flt_level_eq", "level = err", "level = 5")
_filter("flt_level_ge", "level >= Warning", "level >= 4")
_filter("flt_level_ne", "not level != info and @l <> Debug", "level = 3")
_filter("flt_level_unknown", "level = nonsense or level != gibberish", "true")
_filter("flt_num_range", "value > 100 and value <= 400.5", "value > 100 AND value <= 400.5")
_filter("flt_num_eq_string_literal", "userId = '7' or userId = \"7.0\"", "user_id = 7")
_filter("flt_prop_json_num", "k >= 50", "k >= 50")
_filter("flt_bool_literal_never", "userId = true or value > false", "false")
_filter("flt_contains_ci", "message contains 'ERROR BY'", "contains(lower(message), 'error by')")
_filter("flt_bare_string", "'User 12'", "contains(lower(message), 'user 12')")
_filter("flt_number_contains", "userId contains 12", "contains(CAST(user_id AS VARCHAR), '12')")
_filter("flt_missing_not_equal", "environment != staging", "environment IS NULL OR environment <> 'staging'")
_filter("flt_not_nnf", "not (environment = staging or not level >= Warning)", "(environment IS NULL OR environment <> 'staging') AND level >= 4")
_filter("flt_null_test", "environment = null and service != null", "environment IS NULL")
_filter("flt_absent_property", "nothing != 1 and not other = 'x' and third = null", "true")
_filter("flt_precedence", "level = Error or level = Warning and not environment = production", "level = 5 OR (level = 4 AND (environment IS NULL OR environment <> 'production'))")
_filter("flt_text_order", "service > 'svc-5' and environment < 'q'", "service > 'svc-5' AND environment < 'q'")
_filter("flt_array_any", "tags = u1", "list_contains(tags, 'u1')")
_filter("flt_array_none", "tags != u1 and not tags contains 'ERR'", "NOT list_contains(tags, 'u1') AND event_type <> 'error'")
_filter("flt_time_literal", f"timestamp >= '{FROM}' and @t < 1705017600", f"ts_ns >= {FROM_NS} AND ts_ns < 1705017600000000000")
_filter("flt_time_contains", "timestamp contains '-07T1'", "contains(strftime(ts, '%Y-%m-%dT'), '-07T') AND hour(ts) BETWEEN 10 AND 19")
_filter("flt_id_normalised", "traceId = '000000000000000000000000000003E8'", "trace_id = '000000000000000000000000000003e8'", views.spans, ("id", "trace_id", "span_id", "name"), SPANS, "spans")
_filter("flt_span_duration", "durationMs > 45 and status = Error", "duration_ns / 1e6 > 45 AND status = 'Error'", views.spans, ("id", "trace_id", "duration_ns"), SPANS, "spans")
_filter("flt_text_scan_documents", "'ing of' and not env = de", "contains(lower(message), 'ing of') AND environment <> 'de'", views.documents, ("id", "service", "environment"), "docs AS (SELECT doc_id AS id, text AS message, source AS service, lang AS environment FROM documents)", "docs")


@query(f"WITH {LOGS} SELECT {', '.join(ROW)} FROM logs WHERE ts_ns >= {FROM_NS} AND ts_ns < {TO_NS}")
def flt_time_range(spark, sf_dir):
    return matching(views.logs(spark, sf_dir), None, FROM_NS, TO_NS).select(*ROW)


@query(f"WITH {LOGS} SELECT id, level = 5 AS is_error, coalesce(environment <> 'staging', true) AS not_staging FROM logs")
def flt_as_flags(spark, sf_dir):
    v = views.logs(spark, sf_dir)
    return v.df.select("id", flag(parse("level = Error"), v).alias("is_error"), flag(parse("not environment = staging"), v).alias("not_staging"))


@query(f"WITH {LOGS} SELECT {', '.join(ROW)} FROM logs WHERE level = 5 AND value > 100 ORDER BY ts_ns DESC, id DESC LIMIT 20")
def search_backward(spark, sf_dir):
    return search.newest(views.logs(spark, sf_dir), parse("level = Error and value > 100"), limit=20).select(*ROW)


@query(f"WITH {LOGS} SELECT {', '.join(ROW)} FROM logs WHERE service = 'svc-3' AND ts_ns >= {FROM_NS} AND ts_ns < {TO_NS} ORDER BY ts_ns, id LIMIT 50")
def search_forward(spark, sf_dir):
    return search.newest(views.logs(spark, sf_dir), parse("service = svc-3"), FROM_NS, TO_NS, 50, forward=True).select(*ROW)


@query(f"WITH {LOGS} SELECT {', '.join(ROW)} FROM logs WHERE level >= 4 ORDER BY ts_ns DESC, id DESC LIMIT 25 OFFSET 25")
def search_page2(spark, sf_dir):
    v = views.logs(spark, sf_dir)
    first = search.page(v, parse("level >= Warning"), limit=25)
    return search.newest(v, parse("level >= Warning"), limit=25, cursor=search.Cursor.decode(first.next)).select(*ROW)


@query("SELECT count(*) AS count FROM events")
def count_all(spark, sf_dir):
    return search.count(views.logs(spark, sf_dir))


@query(f"WITH {LOGS} SELECT count(*) AS count FROM logs WHERE level = 5 AND environment = 'production'")
def count_filtered(spark, sf_dir):
    return search.count(views.logs(spark, sf_dir), parse("level = Error and env = production"))


_HIST = "b AS (SELECT generate_series AS bucket FROM generate_series({first}, {last}, {step}))"
_HOURS3 = 10_800_000 * series.MS


@query(f"""WITH {LOGS}, {_HIST.format(first=FROM_NS, last=TO_NS - 1, step=_HOURS3)},
c AS (SELECT ts_ns - ts_ns % {_HOURS3} AS bucket, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE level = {k}) AS l{k}' for k in range(1, 7))} FROM logs WHERE ts_ns >= {FROM_NS} AND ts_ns < {TO_NS} GROUP BY 1)
SELECT b.bucket, coalesce(n, 0) AS count, CAST(0 AS BIGINT) AS none, {', '.join(f'coalesce(l{k}, 0) AS level_{k}' for k in range(1, 7))} FROM b LEFT JOIN c USING (bucket)""")
def histogram_levels(spark, sf_dir):
    h = series.histogram(views.logs(spark, sf_dir), None, FROM_NS, TO_NS, 60)
    return h.select("bucket", "count", F.col("levels")[0].alias("none"), *(F.col("levels")[k].alias(f"level_{k}") for k in range(1, 7)))


@query(f"""WITH {LOGS}, {_HIST.format(first=FROM_NS, last=TO_NS - 1, step=600_000 * series.MS)},
c AS (SELECT ts_ns - ts_ns % {600_000 * series.MS} AS bucket, count(*) AS n FROM logs WHERE user_id = 7 AND ts_ns >= {FROM_NS} AND ts_ns < {TO_NS} GROUP BY 1)
SELECT b.bucket, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (bucket)""")
def histogram_sparse(spark, sf_dir):
    return series.histogram(views.logs(spark, sf_dir), parse("userId = 7"), FROM_NS, TO_NS, step_ms=600_000, levels=False)


_FACETS = """WITH {logs}, s AS (SELECT *, row_number() OVER (ORDER BY ts_ns DESC, id DESC) AS n FROM logs QUALIFY n <= {sample}),
f AS (SELECT n, 'level' AS field, ['Trace','Debug','Information','Warning','Error'][level] AS value FROM s UNION ALL SELECT n, 'service', service FROM s
 UNION ALL SELECT n, 'environment', environment FROM s UNION ALL SELECT n, 'userId', CAST(user_id AS VARCHAR) FROM s UNION ALL SELECT n, 'k', CAST(k AS VARCHAR) FROM s
 UNION ALL SELECT n, 'kind', event_type FROM s UNION ALL SELECT n, 'tags', unnest(tags) FROM s),
g AS (SELECT field, count(DISTINCT n) AS events FROM f WHERE value IS NOT NULL AND {fields} GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY CASE field WHEN 'level' THEN 0 WHEN 'service' THEN 1 WHEN 'environment' THEN 2 ELSE 6 END, events DESC, field) AS rank FROM g),
v AS (SELECT field, value, count(*) AS count, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS value_rank, count(*) OVER (PARTITION BY field) AS alls FROM f WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT CAST(rank AS INT) AS rank, field, events, alls > 10 AS truncated, CAST(value_rank AS INT) AS value_rank, value, count FROM r JOIN v USING (field) WHERE value_rank <= 10"""


@query(_FACETS.format(logs=LOGS, sample=2000, fields="field IN ('level','service','environment','kind','tags','k')"))
def facets_top_values(spark, sf_dir):
    return facets.facets(views.logs(spark, sf_dir), only=["level", "service", "environment", "kind", "tags", "k"])


@query(_FACETS.format(logs=LOGS, sample=500, fields="field IN ('level','tags')"))
def facets_field_subset(spark, sf_dir):
    return facets.facets(views.logs(spark, sf_dir), sample=500, only=["tags", "level"])


_METRIC_FROM, _METRIC_TO = FROM_NS, TO_NS
_STEP = 21_600_000


def _metric(name: str, agg: str, sql: str) -> None:
    def run(spark, sf_dir):
        out = series.metric_series(views.metrics(spark, sf_dir), "events.purchase", _METRIC_FROM, _METRIC_TO, agg, _STEP)
        return out.select("bucket", F.round("value", 4).alias("value"))

    step = _STEP * series.MS
    QUERIES[name] = run
    SQL[name] = f"""WITH {METRICS}, {_HIST.format(first=_METRIC_FROM, last=_METRIC_TO - 1, step=step)},
m AS (SELECT ts_ns - ts_ns % {step} AS bucket, CAST({sql} AS DOUBLE) AS v FROM metrics WHERE name = 'events.purchase' AND ts_ns >= {_METRIC_FROM} AND ts_ns < {_METRIC_TO} GROUP BY 1)
SELECT b.bucket, round(v, 4) AS value FROM b LEFT JOIN m USING (bucket)"""


for _a, _s in {"sum": "sum(value)", "count": "count(*)", "min": "min(value)", "max": "max(value)", "avg": "avg(value)", "last": "arg_max(value, (ts_ns, id))"}.items():
    _metric(f"metric_{_a}", _a, _s)


@query(f"""WITH {METRICS}, p AS (SELECT * FROM metrics WHERE name = 'events.view' AND ts_ns >= {FROM_NS} AND ts_ns < {TO_NS}),
g AS (SELECT CAST(user_id AS VARCHAR) AS g, min((ts_ns, id)) AS seen FROM p GROUP BY 1), k AS (SELECT g FROM g ORDER BY seen LIMIT 20),
q AS (SELECT CASE WHEN k.g IS NULL THEN '(other)' ELSE k.g END AS grp, ts_ns - ts_ns % {86_400_000 * series.MS} AS bucket, value FROM p LEFT JOIN k ON CAST(p.user_id AS VARCHAR) = k.g),
s AS (SELECT grp, bucket, sum(value) AS v FROM q GROUP BY 1, 2), {_HIST.format(first=FROM_NS, last=TO_NS - 1, step=86_400_000 * series.MS)}
SELECT d.grp AS "group", d.bucket, round(v, 4) AS value FROM (SELECT * FROM (SELECT DISTINCT grp FROM q), b) d LEFT JOIN s ON d.grp = s.grp AND d.bucket = s.bucket""")
def metric_grouped_other(spark, sf_dir):
    out = series.metric_series(views.metrics(spark, sf_dir), "events.view", FROM_NS, TO_NS, "sum", 86_400_000, "user")
    return out.select("group", "bucket", F.round("value", 4).alias("value"))


_Y0, _Y1 = parse_rfc3339("1990-01-01T00:00:00Z"), parse_rfc3339("2000-01-01T00:00:00Z")
_MONTHISH = 30 * 86_400_000


@query(f"""WITH p AS (SELECT epoch_ns(CAST(o_orderdate AS TIMESTAMP)) AS ts_ns, o_orderstatus AS g, count(*) AS c, sum(CAST(l_quantity AS DOUBLE)) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, 1, 2),
q AS (SELECT g, ts_ns - ts_ns % {_MONTHISH * series.MS} AS bucket, sum(s) / sum(c) AS v FROM p WHERE ts_ns >= {_Y0} AND ts_ns < {_Y1} GROUP BY 1, 2),
b AS (SELECT generate_series AS bucket FROM generate_series({_Y0 - _Y0 % (_MONTHISH * series.MS)}, {_Y1 - 1}, {_MONTHISH * series.MS}))
SELECT d.g AS "group", d.bucket, round(v, 4) AS value FROM (SELECT * FROM (SELECT DISTINCT g FROM q), b) d LEFT JOIN q ON d.g = q.g AND d.bucket = q.bucket""")
def metric_histogram_points(spark, sf_dir):
    out = series.metric_series(views.histograms(spark, sf_dir), "order.lines", _Y0, _Y1, "avg", _MONTHISH, "status")
    return out.select("group", "bucket", F.round("value", 4).alias("value"))


@query(f"WITH {METRICS}, n AS (SELECT DISTINCT name FROM metrics) SELECT name, (SELECT count(*) FROM n) > 1000 AS truncated FROM n ORDER BY name LIMIT 1000")
def metric_names(spark, sf_dir):
    return series.metric_names(views.metrics(spark, sf_dir))


@query(f"WITH {METRICS} SELECT '1' AS unit, 'gauge' AS kind, arg_min(replace(name, 'events.', ''), (ts_ns, id)) AS description FROM metrics WHERE name = 'events.purchase' AND ts_ns >= {FROM_NS} AND ts_ns < {TO_NS} HAVING count(*) > 0")
def metric_meta(spark, sf_dir):
    return series.metric_meta(views.metrics(spark, sf_dir), "events.purchase", FROM_NS, TO_NS)


_SUMMARY = """sums AS (SELECT trace_id, min(ts_ns) AS start, (max(ts_ns + duration_ns) - min(ts_ns)) / 1e6 AS duration_ms, count(*) AS span_count, string_agg(DISTINCT service, ',' ORDER BY service) AS services,
 CAST(count(*) FILTER (WHERE status = 'Error') AS BIGINT) AS error_count FROM t GROUP BY 1),
roots AS (SELECT trace_id, arg_min(name, (ts_ns, id)) AS root_name, arg_min(service, (ts_ns, id)) AS root_service FROM t
 WHERE parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM t u WHERE u.trace_id = t.trace_id AND u.span_id = t.parent_span_id) GROUP BY 1)"""
_SUMMARY_COLS = "trace_id, root_name, root_service, start, duration_ms, span_count, services, error_count"


def _summary(df: DataFrame) -> DataFrame:
    return df.withColumn("services", F.when(F.size("services") > 0, F.array_join("services", ","))).select(*_SUMMARY_COLS.split(", "))


@query(f"WITH {SPANS}, t AS (SELECT * FROM spans WHERE span_id NOT LIKE '%00' OR id % 300 <> 0), {_SUMMARY} SELECT {_SUMMARY_COLS} FROM sums LEFT JOIN roots USING (trace_id)")
def trace_summary(spark, sf_dir):
    """Of all traces, where every third trace's... root ids that 300 divides are missing when their hex ends in 00, which leaves orphans."""
    v = views.spans(spark, sf_dir)
    df = v.df.where(~F.col("span_id").endswith("00") | (F.col("id") % 300 != 0))
    return _summary(traces.summarize(traces._spans(v, df), None))


@query(f"""WITH {SPANS}, h AS (SELECT * FROM spans WHERE status = 'Error' ORDER BY ts_ns DESC, id DESC LIMIT 10000),
c AS (SELECT trace_id, max((ts_ns, id)) AS seen, min(ts_ns) AS lo, max(ts_ns) AS hi FROM h GROUP BY 1 ORDER BY seen DESC LIMIT 50),
t AS (SELECT spans.* FROM spans WHERE trace_id IN (SELECT trace_id FROM c) AND ts_ns BETWEEN (SELECT min(lo) FROM c) - {traces.HOUR} AND (SELECT max(hi) FROM c) + {traces.HOUR}), {_SUMMARY}
SELECT {_SUMMARY_COLS} FROM sums LEFT JOIN roots USING (trace_id)""")
def trace_search(spark, sf_dir):
    return _summary(traces.trace_search(views.spans(spark, sf_dir), parse("status = Error")))


@query(f"""WITH {SPANS} SELECT trace_id, span_id, name, ts_ns - min(ts_ns) OVER (PARTITION BY trace_id) AS offset_ns, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns, id) AS INT) AS position FROM spans""")
def trace_waterfall(spark, sf_dir):
    return traces.waterfall(views.spans(spark, sf_dir)).select("trace_id", "span_id", "name", "offset_ns", "position")


@query(f"WITH {SPANS} SELECT id, span_id, parent_span_id, name FROM spans WHERE trace_id = '0000000000000000000000000000002a'")
def trace_by_id(spark, sf_dir):
    return traces.trace_spans(views.spans(spark, sf_dir), "0000000000000000000000000000002A").select("id", "span_id", "parent_span_id", "name")


@query(f"WITH {LOGS}, {SPANS} SELECT trace_id, logs.id AS log_id, message AS log_message, span_id, name AS span_name FROM logs JOIN spans USING (trace_id) WHERE level = 5 AND status = 'Error'")
def correlated_logs(spark, sf_dir):
    return search.correlate(views.logs(spark, sf_dir), views.spans(spark, sf_dir), parse("level = Error"), parse("status = Error"))


@query(f"WITH {LOGS} SELECT id, message FROM logs WHERE trace_id = '00000000000000000000000000000005'")
def trace_logs(spark, sf_dir):
    return search.trace_logs(views.logs(spark, sf_dir), "00000000000000000000000000000005").select("id", "message")


@query(f"WITH {LOGS} SELECT 'errors' AS alert, CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) > 50 THEN 'FIRING' ELSE 'OK' END AS status FROM logs WHERE level = 5 AND ts_ns >= {NOW_NS - 86_400 * 10**9} AND ts_ns < {NOW_NS + 1}")
def alert_window_count(spark, sf_dir):
    a = alerts.Alert("errors", "level = Error", ">", 50, window_secs=86_400).validate()
    e = alerts.evaluate(a, views.logs(spark, sf_dir), NOW_NS)
    return spark.createDataFrame([(a.name, e.value, e.status)], "alert string, value double, status string")


@query("""SELECT 'user_id' AS field, count(user_id) AS present, CAST(min(user_id) AS DOUBLE) AS min, CAST(max(user_id) AS DOUBLE) AS max, count(DISTINCT user_id) > 0 AS distinct_is_near FROM events
UNION ALL SELECT 'value', count(value), min(value), max(value), count(DISTINCT value) > 0 FROM events""")
def field_stats(spark, sf_dir):
    from tracewell.operators.stats import field_stats as stats

    df = views.logs(spark, sf_dir).df
    exact = df.agg(F.countDistinct("user_id").alias("user_id"), F.countDistinct("value").alias("value"))
    got = stats(df, ["user_id", "value"]).crossJoin(F.broadcast(exact))  # a row
    n = F.when(F.col("field") == "user_id", F.col("user_id")).otherwise(F.col("value"))
    return got.select("field", "present", "min", "max", (F.abs(F.col("distinct") - n) <= 0.2 * n).alias("distinct_is_near"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN event_id * 1000000000 WHEN event_id % 4 = 1 THEN (event_id + 100000000000) * 1000000 WHEN event_id % 4 = 2 THEN (event_id + 100000000000000) * 1000 ELSE event_id + 100000000000000000 END AS ts_ns FROM events""")
def unix_unit_guess(spark, sf_dir):
    from tracewell.sources.native import unix_ns_col

    e = views.read(spark, sf_dir, "events")
    i = F.col("event_id")
    n = F.when(i % 4 == 0, i).when(i % 4 == 1, i + 100_000_000_000).when(i % 4 == 2, i + 100_000_000_000_000).otherwise(i + 100_000_000_000_000_000)
    return e.select(i.alias("id"), unix_ns_col(n).alias("ts_ns"))


_SPELLINGS = [n for names in LEVEL_NAMES.values() for n in names] + ["nonsense"]


@query(f"""WITH w AS (SELECT event_id AS id, {_SPELLINGS!r}[event_id % {len(_SPELLINGS)} + 1] AS word FROM events)
SELECT id, CASE {' '.join(f"WHEN word IN ({', '.join(map(repr, names))}) THEN {code}" for code, names in LEVEL_NAMES.items())} END AS level,
CASE {' '.join(f"WHEN word IN ({', '.join(map(repr, names))}) THEN '{label}'" for label, names in zip(('Trace', 'Debug', 'Information', 'Warning', 'Error', 'Fatal'), LEVEL_NAMES.values()))} END AS name FROM w""")
def level_alias_parse(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    words = F.array(*map(F.lit, _SPELLINGS))
    blank = F.get(F.array(*map(F.lit, (" ", "\t", "\n", "\u00a0", ""))), (F.col("event_id") % 5).cast("int"))
    word = F.concat(blank, F.upper(F.get(words, (F.col("event_id") % len(_SPELLINGS)).cast("int"))), blank)
    code = level_code_col(word)
    return e.select(F.col("event_id").alias("id"), code.cast("int").alias("level"), level_name_col(code).alias("name"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN lower(to_hex(event_id)) ELSE 'Req-' || event_id END AS norm FROM events")
def id_normalise(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, "0000").when(i % 3 == 1, F.hex(i)).otherwise(F.concat(F.lit("Req-"), i.cast("string")))
    blank = F.get(F.array(*map(F.lit, ("", "\t", " \n"))), (i % 5 % 3).cast("int"))
    return e.select(i.alias("id"), normalise_id_col(F.concat(blank, raw, blank)).alias("norm"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS text FROM events")
def render_time(spark, sf_dir):
    v = views.logs(spark, sf_dir)
    return v.df.select("id", rfc3339_col(F.col("ts_ns")).alias("text"))


def ndjson_round_trip(logs: DataFrame) -> DataFrame:
    """All rows of logs written as NDJSON and read back through ingest."""
    from tracewell.sources.native import parse_frame

    props = F.struct(F.col("user_id").alias("user"), F.struct("value").alias("m"))
    line = F.to_json(F.struct(F.col("ts_ns").alias("timestamp"), level_name_col(F.col("level")).alias("@l"), "service", "message", F.upper("trace_id").alias("traceId"), props.alias("properties")))
    rows = parse_frame(logs.select(line.alias("body")), "ndjson")
    text = lambda path: F.element_at("attr", path)["txt"]
    return rows.select("ts_ns", "service", "message", "trace_id", F.col("level").cast("int").alias("level"), text("user").alias("user"), text("m.value").cast("double").alias("value"))


def otlp_round_trip(logs: DataFrame) -> DataFrame:
    """All rows of logs as OpenTelemetry JSON requests, one record each, decoded."""
    from tracewell.sources.otlp import decode_frame

    def kv(name, kind, value):
        return F.struct(F.lit(name).alias("key"), F.struct(value.alias(kind)).alias("value"))

    record = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), (F.col("level") * 4).alias("severityNumber"), F.struct(F.col("message").alias("stringValue")).alias("body"), F.col("trace_id").alias("traceId"), F.array(kv("k", "intValue", F.col("k").cast("string"))).alias("attributes"))
    resource = F.struct(F.array(kv("service.name", "stringValue", F.col("service"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    rows = decode_frame(logs.select(body.alias("body")), "logs")
    return rows.select("ts_ns", "service", "message", "trace_id", F.col("level").cast("int").alias("level"), F.element_at("attr", "k")["txt"].alias("k"))


@query(f"WITH {LOGS} SELECT ts_ns, service, message, trace_id, level, CAST(user_id AS VARCHAR) AS user, value FROM logs")
def ingest_ndjson(spark, sf_dir):
    return ndjson_round_trip(views.logs(spark, sf_dir).df)


@query(f"WITH {LOGS} SELECT ts_ns, service, message, trace_id, level, CAST(k AS VARCHAR) AS k FROM logs")
def ingest_otlp_logs(spark, sf_dir):
    return otlp_round_trip(views.logs(spark, sf_dir).df)


@query(f"""WITH {LOGS}, w AS (SELECT ts_ns // 21600000000000 * 21600000000000 AS start, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE level = 5 GROUP BY 1)
SELECT start, value, CASE WHEN value > 15 THEN 'FIRING' ELSE 'OK' END AS status FROM w""")
def stream_alert_windows(spark, sf_dir):
    """The events as a stream: an alert's count and status in every window of six hours, run until the input is used up."""
    from tracewell.streaming import live
    from tracewell.streaming.live import alert_stream

    source = spark.readStream.schema(views.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    v = views.logs_of(source)
    a = alerts.Alert("errors", "level = Error", ">", 15, window_secs=6 * 3600, interval_secs=6 * 3600)
    path = new_folder(spark, "alerts")
    rows = alert_stream(v, a)
    live.changes(rows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return live.newest_of(spark.read.parquet(f"{path}/out"), "start").select((F.unix_micros("start") * 1000).alias("start"), "value", "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_backward(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "View", "flagship"]
