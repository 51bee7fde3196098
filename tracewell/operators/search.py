"""Newest-first (or oldest-first) search with keyset paging, counts, and the lookup of one trace's logs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tracewell.operators.limits import DEFAULT_RESULTS, check_limit
from tracewell.plans.ast import Comparison, Expr, conjunction
from tracewell.plans.compiler import in_range, matching
from tracewell.plans.parser import QueryError
from tracewell.plans.view import View

_U64 = 1 << 64


@dataclass(frozen=True)
class Cursor:
    """The last returned position; its text is the API's page token."""

    ts: int
    id: int

    def encode(self) -> str:
        return f"v1.{self.ts % _U64:x}.{self.id % _U64:x}"

    @staticmethod
    def decode(text: str) -> Cursor:
        m = re.fullmatch(r"v1\.\+?([0-9a-fA-F]+)\.\+?([0-9a-fA-F]+)", text)
        parts = [int(x, 16) for x in m.groups()] if m else []
        if not parts or max(parts) >= _U64:
            raise QueryError("invalid cursor")
        signed = [x - _U64 if x >= _U64 // 2 else x for x in parts]
        return Cursor(*signed)


def newest(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None, limit: int = DEFAULT_RESULTS, cursor: Cursor | None = None, forward: bool = False) -> DataFrame:
    """The first `limit` matches by (time, id), newest first, or oldest first with forward, after the cursor.

    A top-k per task and a merge of k rows; the cursor's time is repeated as a bound that files can be pruned with.
    """
    ts, key = view.columns["timestamp"], F.col("id")
    if cursor is not None:
        if forward:
            start = max(start, cursor.ts) if start is not None else cursor.ts
        else:
            stop = min(stop, cursor.ts + 1) if stop is not None else cursor.ts + 1
    df = matching(view, e, start, stop)
    if cursor is not None:
        same = ts == F.lit(cursor.ts)
        df = df.where((ts > cursor.ts) | (same & (key > cursor.id)) if forward else (ts < cursor.ts) | (same & (key < cursor.id)))
    order = [ts.asc(), key.asc()] if forward else [ts.desc(), key.desc()]
    return df.orderBy(*order).limit(limit)


def keys(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None, limit: int = DEFAULT_RESULTS, cursor: Cursor | None = None, forward: bool = False) -> list[tuple[int, int]]:
    """(time, id) of the rows that newest() gives, in their order: the first phase of a search, which reads the filter's columns and these two."""
    found = newest(view, e, start, stop, limit, cursor, forward).select(view.columns["timestamp"].alias("t"), F.col("id").alias("i"))
    return [(r["t"], r["i"]) for r in found.collect()]


def rows_between(view: View, e: Expr | None, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """The matches whose (time, id) lies between the two, both included: the second phase, which reads whole rows of the pages that hold them."""
    (a, i), (b, j) = sorted((first, last))
    ts, key = view.columns["timestamp"], F.col("id")
    df = matching(view, e, a, b + 1)
    return df.where(((ts > a) | (key >= i)) & ((ts < b) | (key <= j)))


@dataclass
class Page:
    rows: list[Row]
    next: str | None


def page(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None, limit: int | None = None, cursor: str | None = None, forward: bool = False) -> Page:
    """One page: at most `limit` rows and the token of the next page if there is one."""
    n = check_limit(limit)
    at = Cursor.decode(cursor) if cursor else None
    found = newest(view, e, start, stop, n + 1, at, forward).withColumn("_page_ts", view.columns["timestamp"]).collect()
    more = len(found) > n
    rows = found[:n]
    token = Cursor(rows[-1]["_page_ts"], rows[-1]["id"]).encode() if more else None
    return Page([Row(**{k: v for k, v in r.asDict().items() if k != "_page_ts"}) for r in rows], token)


def count(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """One row: count. Without filter and bounds Parquet answers from its footers."""
    return matching(view, e, start, stop).agg(F.count(F.lit(1)).alias("count"))


def trace_logs(logs: View, trace_id: str) -> DataFrame:
    """The logs of one trace, oldest first."""
    return matching(logs, Comparison("traceId", "=", trace_id)).orderBy(logs.columns["timestamp"], "id")


def correlate(logs: View, spans: View, e: Expr | None = None, span_filter: Expr | None = None) -> DataFrame:
    """Logs beside the spans of their trace: an equi-join on the trace id, filtered on both sides first."""
    left = matching(logs, conjunction(Comparison("traceId", "!=", None), e))
    right = matching(spans, conjunction(Comparison("traceId", "!=", None), span_filter))
    left = left.select(logs.columns["traceId"].alias("trace_id"), F.col("id").alias("log_id"), logs.columns["message"].alias("log_message"))
    right = right.select(spans.columns["traceId"].alias("trace_id"), spans.columns["spanId"].alias("span_id"), spans.columns["message"].alias("span_name"))
    return left.join(right, "trace_id")


def correlate_counts(logs: View, spans: View, e: Expr | None = None, span_filter: Expr | None = None) -> DataFrame:
    """Per trace that has both: how many logs and spans match. Each side is counted before the join, so a hot trace is a row on either."""
    left = matching(logs, conjunction(Comparison("traceId", "!=", None), e)).groupBy(logs.columns["traceId"].alias("trace_id")).agg(F.count(F.lit(1)).alias("logs"))
    right = matching(spans, conjunction(Comparison("traceId", "!=", None), span_filter)).groupBy(spans.columns["traceId"].alias("trace_id")).agg(F.count(F.lit(1)).alias("spans"))
    return left.join(right, "trace_id")


__all__ = ["Cursor", "Page", "correlate", "correlate_counts", "keys", "rows_between", "count", "in_range", "newest", "page", "trace_logs"]
