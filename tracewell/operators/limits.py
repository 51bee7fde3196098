"""Limits, cancellation and diagnostics of a request."""

from __future__ import annotations

import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.ast import Expr, comparisons
from tracewell.plans.parser import QueryError

MAX_RESULTS, DEFAULT_RESULTS = 1000, 200
MAX_POINTS = 10_000
SUMMARY_SPANS, TRACE_SPANS = 10_000, 50_000


class QueryTimeout(QueryError):
    status, code = 504, "query_timeout"

    def __init__(self, ms: int):
        super().__init__(f"query exceeded its time limit of {ms} ms", limit=ms)


class TooExpensive(QueryError):
    status, code = 422, "query_too_expensive"

    def __init__(self, limit: int):
        super().__init__(f"query would scan more than {limit} bytes; narrow the time range or add filters", limit=limit)


class ResultLimit(QueryError):
    status, code = 422, "query_result_limit"

    def __init__(self, what: str, limit: int, hint: str):
        super().__init__(f"query result would exceed {limit} {what}; {hint}", limit=limit, what=what)


class Cancelled(QueryError):
    status, code = 499, "query_cancelled"

    def __init__(self):
        super().__init__("query was cancelled")


class Busy(QueryError):
    status, code = 503, "busy"

    def __init__(self):
        super().__init__("too many queries are running")


class UnknownSignal(QueryError):
    status, code = 404, "not_found"


def check_limit(limit: int | None, most: int = MAX_RESULTS, default: int = DEFAULT_RESULTS) -> int:
    n = default if limit is None else limit
    if not 1 <= n <= most:
        raise QueryError(f"'limit' must be between 1 and {most}")
    return n


class CancelToken:
    """Cancels the Spark jobs of the budgets that hold it."""

    def __init__(self):
        self.event = threading.Event()

    def cancel(self) -> None:
        self.event.set()


@dataclass
class Budget:
    """Time and bytes of a request, shared by its phases. A byte limit is inclusive and tested before a scan runs."""

    time_ms: int = 30_000
    bytes: int = 4 << 30
    token: CancelToken = field(default_factory=CancelToken)
    scanned: int = 0
    started: float = field(default_factory=time.monotonic)

    def check(self) -> None:
        if self.token.event.is_set():
            raise Cancelled()
        if (time.monotonic() - self.started) * 1000 > self.time_ms:
            raise QueryTimeout(self.time_ms)

    def charge(self, n: int) -> None:
        self.check()
        if self.scanned + n > self.bytes:
            raise TooExpensive(self.bytes)
        self.scanned += n

    @contextmanager
    def running(self, spark: SparkSession):
        """Jobs started inside are interrupted when the token is cancelled or the time is over."""
        self.check()
        tag, done = f"tracewell-{uuid.uuid4().hex}", threading.Event()

        def watch():
            while not done.wait(0.05):
                try:
                    self.check()
                except QueryError:
                    spark.interruptTag(tag)
                    return

        spark.addTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield self
        except QueryError:
            raise
        except Exception:
            self.check()  # an interrupted job is reported as what interrupted it
            raise
        finally:
            done.set()
            spark.removeTag(tag)
        self.check()


class Admission:
    """At most `running` queries at once; others wait up to wait_ms and are then refused."""

    def __init__(self, running: int = 4, wait_ms: int = 1000):
        self.slots, self.wait = threading.BoundedSemaphore(running), wait_ms / 1000

    @contextmanager
    def slot(self):
        if not self.slots.acquire(timeout=self.wait):
            raise Busy()
        try:
            yield
        finally:
            self.slots.release()


@dataclass
class Diagnostics:
    """What a request did: files considered, skipped and read, bytes, events examined and matched, the fields filtered on."""

    files_considered: int = 0
    files_skipped: int = 0
    files_read: int = 0
    bytes_read: int = 0
    events_examined: int = 0
    events_matched: int = 0
    fields: tuple[str, ...] = ()
    elapsed_ms: float = 0.0

    def merged(self, other: Diagnostics) -> Diagnostics:
        numbers = ("files_considered", "files_skipped", "files_read", "bytes_read", "events_examined", "events_matched", "elapsed_ms")
        return Diagnostics(**{n: getattr(self, n) + getattr(other, n) for n in numbers}, fields=tuple(dict.fromkeys(self.fields + other.fields)))


def fields_of(e: Expr | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c.field for c in comparisons(e)))


class QueryStats:
    """Sums per (signal, field) of how often a field was filtered on and what the scans did."""

    def __init__(self):
        self.rows: dict[tuple[str, str], dict[str, Any]] = {}
        self.lock = threading.Lock()

    def record(self, signal: str, d: Diagnostics, now_ms: int) -> None:
        with self.lock:
            for name in d.fields:
                r = self.rows.setdefault((signal, name), {"queries": 0, "files_scanned": 0, "files_skipped": 0, "total_ms": 0.0, "last_seen": 0})
                r["queries"] += 1
                r["files_scanned"] += d.files_read
                r["files_skipped"] += d.files_skipped
                r["total_ms"] += d.elapsed_ms
                r["last_seen"] = max(r["last_seen"], now_ms)

    def frame(self, spark: SparkSession) -> DataFrame:
        data = [(s, f, r["queries"], r["files_scanned"], r["files_skipped"], r["total_ms"], r["last_seen"]) for (s, f), r in sorted(self.rows.items())]
        return spark.createDataFrame(data, "signal string, field string, queries long, files_scanned long, files_skipped long, total_ms double, last_seen long")
