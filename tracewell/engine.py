"""The read operations of the API over a store, with its validation, defaults and errors."""

from __future__ import annotations

import time
from typing import Any

from tracewell.functions.times import time_range
from tracewell.operators import facets as _facets
from tracewell.operators import search, series, traces
from tracewell.operators.limits import Admission, Budget, QueryStats, ResultLimit, check_limit, fields_of
from tracewell.operators.series import choose_step_ms
from tracewell.plans.ast import Expr
from tracewell.plans.parser import parse
from tracewell.sources.table import Store

HOUR_MS = 3_600_000


class Engine:
    """Each call takes a slot, runs under a budget and leaves its diagnostics in `last` and in `stats`."""

    def __init__(self, store: Store, running: int = 4, budget: dict[str, Any] | None = None):
        self.store, self.admission, self.limits = store, Admission(running), budget or {}
        self.stats, self.last = QueryStats(), None

    def _run(self, signal: str, query: str, start: Any, stop: Any, now: int | None, default_ms: int | None, work, lazily: bool = False) -> Any:
        """work(view, filter, from, to), or with lazily work(table, filter, from, to, budget, manifest), which reads and charges what it needs and gives its diagnostics too."""
        now = time.time_ns() if now is None else now
        e: Expr | None = parse(query or "")
        a, b = time_range(start, stop, now, default_ms)
        table = self.store[signal]
        with self.admission.slot():
            budget, m = Budget(**self.limits), table.manifest()
            began = time.monotonic()
            with budget.running(table.spark):
                if lazily:
                    out, self.last = work(table, e, a, b, budget, m)
                else:
                    out, self.last = work(table.view(a, b, budget, m), e, a, b), table.diagnose(a, b, m)
            self.last.fields, self.last.elapsed_ms = fields_of(e), (time.monotonic() - began) * 1000
            self.stats.record(signal, self.last, now // 1_000_000)
            return out

    def events(self, signal: str, query: str = "", start: Any = None, stop: Any = None, limit: int | None = None, cursor: str | None = None, forward: bool = False, now: int | None = None) -> search.Page:
        """A page of matches, newest first. Files are read in that order, and no more than it takes."""
        n = check_limit(limit)
        at = search.Cursor.decode(cursor) if cursor else None

        def work(table, e, a, b, budget, m):
            rows, done = table.latest(e, a, b, n + 1, at, forward, budget, m)
            token = search.Cursor(rows[n - 1]["ts_ns"], rows[n - 1]["id"]).encode() if len(rows) > n else None
            return search.Page(rows[:n], token), done

        return self._run(signal, query, start, stop, now, None, work, lazily=True)

    def count(self, signal: str, query: str = "", start: Any = None, stop: Any = None, now: int | None = None) -> int:
        return self._run(signal, query, start, stop, now, None, lambda v, e, a, b: search.count(v, e, a, b).first()[0])

    def histogram(self, signal: str, query: str = "", start: Any = None, stop: Any = None, buckets: int = 60, now: int | None = None) -> dict:
        def work(v, e, a, b):
            rows = series.histogram(v, e, a, b, buckets).collect()
            return {"stepMs": choose_step_ms(a, b, buckets), "total": sum(r["count"] for r in rows), "buckets": rows}

        return self._run(signal, query, start, stop, now, HOUR_MS, work)

    def facets(self, signal: str, query: str = "", start: Any = None, stop: Any = None, fields: list[str] | None = None, sample: int = _facets.SAMPLE, now: int | None = None) -> dict:
        def work(v, e, a, b):
            rows = _facets.facets(v, e, a, b, sample, only=fields, with_sampled=True).collect()
            listed: dict[str, dict] = {}
            for r in rows:
                f = listed.setdefault(r["field"], {"field": r["field"], "count": r["events"], "truncated": r["truncated"], "values": []})
                f["values"].append({"value": r["value"], "count": r["count"]})
            return {"sampled": rows[0]["sampled"] if rows else min(sample, search.count(v, e, a, b).first()[0]), "fields": list(listed.values())}

        return self._run(signal, query, start, stop, now, None, work)

    def metric(self, name: str, query: str = "", start: Any = None, stop: Any = None, agg: str = "avg", group_by: str | None = None, step_ms: int | None = None, now: int | None = None) -> dict:
        def work(v, e, a, b):
            rows = series.metric_series(v, name, a, b, agg, step_ms, group_by, e).collect()
            groups: dict[str | None, list] = {}
            for r in rows:
                groups.setdefault(r["group"], []).append((r["bucket"], r["value"]))
            meta = series.metric_meta(v, name, a, b, e).first()
            return {"stepMs": step_ms if step_ms and step_ms >= 1000 else choose_step_ms(a, b, 120), "series": groups, "meta": meta.asDict() if meta else {}}

        return self._run("metrics", query, start, stop, now, HOUR_MS, work)

    def metric_names(self, most: int = 1000) -> tuple[list[str], bool]:
        rows = self._run("metrics", "", None, None, None, None, lambda v, *_: series.metric_names(v, most).collect())
        return sorted(r["name"] for r in rows), any(r["truncated"] for r in rows)

    def traces(self, query: str = "", start: Any = None, stop: Any = None, limit: int = traces.DEFAULT_TRACES, now: int | None = None) -> list:
        def work(_, e, a, b):
            # phase 2 reads spans outside the request's range
            return traces.trace_search(self.store["traces"].view(None if a is None else a - 2 * traces.HOUR, None if b is None else b + 2 * traces.HOUR), e, a, b, limit).collect()

        return self._run("traces", query, start, stop, now, None, work)

    def trace(self, trace_id: str) -> list:
        return self._run("traces", "", None, None, None, None, lambda v, *_: traces.trace(v, trace_id))

    def panel(self, kind: str, config: dict, start: Any = None, stop: Any = None, now: int | None = None) -> Any:
        """A dashboard panel: log_count, metric_line, single_stat or saved_query."""
        q = config.get("query", "")
        if kind == "log_count":
            return self.histogram("logs", q, start, stop, 40, now)
        if kind == "metric_line":
            return self.metric(config["metric"], q, start, stop, config.get("agg", "avg"), config.get("groupBy"), now=now)
        if kind == "single_stat":
            if "metric" not in config:
                return self.count("logs", q, start, stop, now)
            a, b = time_range(start, stop, time.time_ns() if now is None else now, HOUR_MS)
            found = self.metric(config["metric"], q, start, stop, config.get("agg", "avg"), step_ms=max(1000, (b - a) // 1_000_000), now=now)["series"]
            values = [v for points in found.values() for _, v in points if v is not None]
            return values[-1] if values else None
        if kind == "saved_query":
            return self.events("logs", q, start, stop, 10, now=now).rows
        raise ValueError(f"unknown panel '{kind}'")


__all__ = ["Engine", "ResultLimit"]
