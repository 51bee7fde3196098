"""Threshold alerts: definition, evaluation over a trailing window, and the state machine."""

from __future__ import annotations

import json
import math
import operator
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from tracewell.operators.search import count
from tracewell.plans.parser import QueryError, parse
from tracewell.plans.view import View

CONDITIONS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "!=": operator.ne}
OK, FIRING, ERROR = "OK", "FIRING", "ERROR"
TICK_SECS = 5


class InvalidAlert(QueryError):
    code = "invalid_alert"


def holds(value: float, op: str, threshold: float) -> bool:
    return op in CONDITIONS and CONDITIONS[op](value, threshold)


@dataclass(frozen=True)
class Alert:
    name: str
    query: str
    op: str
    threshold: float
    window_secs: int = 300
    interval_secs: int = 60
    signal: str = "logs"
    webhook_url: str = ""
    enabled: bool = True

    def validate(self) -> Alert:
        for wrong, said in (
            (not self.name.strip(), "alert name is required"),
            (self.op not in CONDITIONS, "condition must be one of " + " ".join(CONDITIONS)),
            (not math.isfinite(self.threshold), "threshold must be a finite number"),
            (not 1 <= self.window_secs <= 31 * 86_400, "window must be between 1 second and 31 days"),
            (not 10 <= self.interval_secs <= 86_400, "evaluation interval must be between 10 seconds and 1 day"),
            (self.webhook_url and not self.webhook_url.startswith(("http://", "https://")), "webhook URL must start with http:// or https://"),
        ):
            if wrong:
                raise InvalidAlert(said)
        parse(self.query)
        return self


@dataclass(frozen=True)
class Evaluation:
    status: str
    value: float | None
    error: str | None = None


def evaluate(alert: Alert, view: View, now_ns: int) -> Evaluation:
    """Counts the matches of the trailing window, now included; an error of the query is the alert's state, not an exception."""
    try:
        n = float(count(view, parse(alert.query), now_ns - alert.window_secs * 1_000_000_000, now_ns + 1).first()[0])
    except Exception as e:
        return Evaluation(ERROR, None, str(e).splitlines()[0][:500])
    return Evaluation(FIRING if holds(n, alert.op, alert.threshold) else OK, n)


@dataclass
class State:
    status: str = OK
    value: float | None = None
    evaluated_ms: int | None = None
    transition_ms: int | None = None
    error: str | None = None


class Memory(Protocol):
    """Where states and transitions outlive the process: tracewell.sources.alert_store.AlertStore."""

    def read(self) -> tuple[dict[str, dict], list[dict]]: ...

    def write(self, states: dict[str, dict], entry: dict | None) -> None: ...


@dataclass
class Monitor:
    """Alerts, their states, and the history of transitions: one entry per change of status.

    send: called with the webhook's address and the entry; without it they are posted. With a memory, states and history are what an earlier monitor left.
    """

    alerts: list[Alert]
    send: Callable[[str, dict], Any] | None = None
    states: dict[str, State] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    memory: Memory | None = None

    def __post_init__(self):
        if self.memory is not None:
            states, history = self.memory.read()
            self.states = {**{k: State(**v) for k, v in states.items()}, **self.states}
            self.history = history + self.history

    def due(self, now_ms: int) -> list[Alert]:
        out = []
        for a in self.alerts:
            last = self.states.setdefault(a.name, State()).evaluated_ms
            if a.enabled and (last is None or now_ms - last >= a.interval_secs * 1000):
                out.append(a)
        return out

    def record(self, alert: Alert, e: Evaluation, now_ms: int) -> str:
        """Keeps the evaluation and gives the status before it."""
        s = self.states.setdefault(alert.name, State())
        before = s.status
        s.value, s.evaluated_ms, s.error = e.value, now_ms, e.error
        entry = None
        if before != e.status:
            s.status, s.transition_ms = e.status, now_ms
            entry = {"alert": alert.name, "from": before, "to": e.status, "value": e.value, "message": e.error, "at": now_ms}
            self.history.append(entry)
        if self.memory is not None:
            self.memory.write({k: asdict(v) for k, v in self.states.items()}, entry)
        if entry and alert.webhook_url:
            (self.send or send_webhook)(alert.webhook_url, entry)
        return before

    def tick(self, views: dict[str, View], now_ns: int) -> list[tuple[Alert, Evaluation]]:
        """Evaluates what is due; to be called every TICK_SECS."""
        out = []
        for a in self.due(now_ns // 1_000_000):
            e = evaluate(a, views[a.signal], now_ns)
            self.record(a, e, now_ns // 1_000_000)
            out.append((a, e))
        return out


def send_webhook(url: str, payload: dict, post: Callable[[str, bytes], int] | None = None, wait: Callable[[float], None] | None = None, attempts: int = 3) -> bool:
    """Posts JSON up to three times. A client error other than 429 is final."""
    import time

    def http(u: str, body: bytes) -> int:
        try:
            with urllib.request.urlopen(urllib.request.Request(u, body, {"Content-Type": "application/json"}), timeout=10) as r:
                return r.status
        except urllib.error.HTTPError as e:
            return e.code

    for k in range(attempts):
        try:
            status = (post or http)(url, json.dumps(payload).encode())
        except OSError:
            status = 0
        if 200 <= status < 300:
            return True
        if 400 <= status < 500 and status != 429:
            return False
        if k + 1 < attempts:
            (wait or time.sleep)(2.0**k)
    return False
