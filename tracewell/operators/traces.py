"""Trace search (summaries of the newest matching traces) and single traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracewell.operators.limits import SUMMARY_SPANS, TRACE_SPANS, ResultLimit
from tracewell.operators.search import newest
from tracewell.plans.ast import Comparison, Expr, conjunction
from tracewell.plans.compiler import matching
from tracewell.plans.view import View

HOUR = 3_600 * 1_000_000_000
PAGE_ROWS, MAX_TRACES, DEFAULT_TRACES = 20 * 500, 200, 50
SALTS = 32


def _spans(view: View, df: DataFrame) -> DataFrame:
    c = view.columns
    return df.select(
        c["traceId"].alias("trace_id"), c["spanId"].alias("span_id"), c["parentSpanId"].alias("parent"), c["timestamp"].alias("ts"),
        F.col("id"), F.col("duration_ns"), c["message"].alias("name"), c["service"].alias("service"), c["status"].alias("status"),
        *([F.col("place")] if "place" in df.columns else []),
    )


def _order(spans: DataFrame) -> list[str]:
    """What spans of a trace are ordered by; of those with the same id the first in the input comes first, where places are known."""
    return ["ts", "id", *(["place"] if "place" in spans.columns else [])]


def summarize(spans: DataFrame, cap: int | None = SUMMARY_SPANS) -> DataFrame:
    """Per trace_id: root_name, root_service, start, duration_ms, span_count, services, error_count, truncated.

    spans: trace_id, span_id, parent, ts, id, duration_ns, name, service, status, and place if ids can be there twice. The root is the earliest span
    without a parent in the trace; ties go to the smaller id, then to the smaller place. With a cap only the first `cap` spans of a trace
    (by time and id) count, and truncated says so; the cap ranks within salted parts of a trace first.
    """
    if cap is None:
        return _summarize_all(spans)
    # no trace can have more than cap spans that matter in any of its parts, so a task never ranks a whole hot trace
    first = _order(spans)
    part = Window.partitionBy("trace_id", "_salt").orderBy(*first)
    spans = spans.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= cap + 1).drop("_k", "_salt")
    order = Window.partitionBy("trace_id").orderBy(*first)
    spans = spans.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap + 1)
    kept = F.col("_k") <= cap
    each = F.when(kept, F.struct(*first, "name", "service", "parent"))
    # a group has cap spans at most, so its ids fit an array: parents that are none of them are looked up in what is left over
    out = spans.groupBy("trace_id").agg(
        F.collect_list(each).alias("each"), F.collect_set(F.when(kept, F.col("span_id"))).alias("ids"), F.collect_set(F.when(kept, F.col("parent"))).alias("parents"),
        *(x.alias(n) for n, x in _numbers(kept).items()), F.max(~kept).alias("truncated"),
    )
    missing = F.array_except("parents", "ids")
    roots = F.transform(F.filter("each", lambda x: x["parent"].isNull() | F.array_contains(F.col("missing"), x["parent"])), lambda x: F.struct(*(x[n].alias(n) for n in (*first, "name", "service"))))
    return _shown(out.withColumn("missing", missing).withColumn("root", F.array_min(roots)), F.col("truncated"))


def _numbers(kept: Column) -> dict[str, Column]:
    took, most = F.col("duration_ns").cast("decimal(20,0)"), F.lit(2**63 - 1).cast("decimal(20,0)")
    end = F.col("ts") + F.when(took > most, most).otherwise(took).cast("long")  # not least, which gives most where there is no duration
    when = lambda x: F.when(kept, x)
    return {"start": F.min(when(F.col("ts"))), "end": F.max(when(end)), "span_count": F.count_if(kept), "services": F.array_sort(F.collect_set(when(F.col("service")))), "error_count": F.count_if(kept & (F.col("status") == "Error"))}


def _shown(out: DataFrame, truncated: Column) -> DataFrame:
    ms = ((F.col("end") - F.col("start")) / 1e6).alias("duration_ms")
    return out.select("trace_id", F.col("root")["name"].alias("root_name"), F.col("root")["service"].alias("root_service"), "start", ms, "span_count", "services", "error_count", truncated.alias("truncated"))


def _summarize_all(spans: DataFrame) -> DataFrame:
    """Without a cap a trace may be larger than a task: roots are found with a join on (trace, parent), not by gathering a trace's spans.

    Spans without a time come last; name and service are each of the first root that has one.
    """
    ids = spans.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s")).where("s is not null").distinct()
    spans = spans.join(ids, (F.col("trace_id") == F.col("t")) & (F.col("parent") == F.col("s")), "left")
    first = [F.col("ts").isNull().alias("no_ts"), *_order(spans)]
    of = lambda n: F.min(F.when(F.col("s").isNull() & F.col(n).isNotNull(), F.struct(*first, n)))[n].alias(n)
    out = spans.groupBy("trace_id").agg(F.struct(of("name"), of("service")).alias("root"), *(x.alias(n) for n, x in _numbers(F.lit(True)).items()))
    return _shown(out, F.lit(False))


def trace_search(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None, limit: int = DEFAULT_TRACES) -> DataFrame:
    """Summaries of the traces of the newest matching spans, latest start first.

    Phase 1, which runs at once, takes the 10,000 newest matches and from them the `limit` traces last seen, at most 200;
    phase 2 filters the spans near those times by the ids, as literals that Parquet prunes with. The request's range bounds phase 1 only.
    """
    limit = max(1, min(limit, MAX_TRACES))
    hits = newest(view, e, start, stop, PAGE_ROWS).select(view.columns["traceId"].alias("trace_id"), view.columns["timestamp"].alias("ts"), "id").where("trace_id is not null")
    chosen = hits.groupBy("trace_id").agg(F.max(F.struct("ts", "id")).alias("seen"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy(F.desc("seen")).limit(limit)
    picked = chosen.collect()  # at most 200 rows
    if not picked:
        return summarize(_spans(view, view.df.where(F.lit(False))))
    lo, hi = min(r["lo"] for r in picked) - HOUR, max(r["hi"] for r in picked) + HOUR
    near = matching(view, None, lo, hi + 1).where(view.columns["traceId"].isin([r["trace_id"] for r in picked]))
    seen = view.df.sparkSession.createDataFrame([(r["trace_id"], -i) for i, r in enumerate(picked)], "trace_id string, seen int")
    out = summarize(_spans(view, near)).join(F.broadcast(seen), "trace_id")
    return out.orderBy(F.desc("start"), F.desc("seen")).drop("seen")


def trace_spans(view: View, trace_id: str, start: int | None = None, stop: int | None = None, e: Expr | None = None) -> DataFrame:
    """All spans of one trace, by start; the id matches in any case."""
    found = matching(view, conjunction(Comparison("traceId", "=", trace_id), e), start, stop)
    return found.orderBy(view.columns["timestamp"], "id")


def trace(view: View, trace_id: str, start: int | None = None, stop: int | None = None, most: int = TRACE_SPANS) -> list[Row]:
    """The spans, or an error if there are more than `most`: never a part of a trace."""
    rows = trace_spans(view, trace_id, start, stop).limit(most + 1).collect()
    if len(rows) > most:
        raise ResultLimit("spans", most, "narrow the time range")
    return rows


def waterfall(view: View, df: DataFrame | None = None, most: int = TRACE_SPANS) -> DataFrame:
    """Spans of every trace with their offset from the trace's start and their place in it; of each trace the first `most`, by time and id."""
    spans = _spans(view, view.df if df is None else df)
    part = Window.partitionBy("trace_id", "_salt").orderBy("ts", "id")
    spans = spans.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= most).drop("_k", "_salt")
    order = Window.partitionBy("trace_id").orderBy("ts", "id")
    return spans.withColumn("offset_ns", F.col("ts") - F.first("ts").over(order)).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
