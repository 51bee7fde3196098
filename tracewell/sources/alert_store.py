"""States and transitions of alerts, kept beside the tables of a store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources.table import Conflict, JsonFolder

HISTORY = "alert string, `from` string, `to` string, value double, message string, at long"


class AlertStore(JsonFolder):
    """<root>/alerts/states/<version>.json holds all states; <root>/alerts/history has a file per transition, which is never changed."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, f"{root.rstrip('/')}/alerts")

    def read(self) -> tuple[dict[str, dict], list[dict]]:
        history = sorted((self._load(f"history/{n}") for n in self._names("history") if n.endswith(".json")), key=lambda h: h["at"])
        return (self._newest("states") or {"states": {}})["states"], history

    def write(self, states: dict[str, dict], entry: dict | None) -> None:
        if entry is not None:
            self._save(f"history/{entry['at']:015d}-{uuid.uuid4().hex}.json", entry)
        for _ in range(5):  # another monitor's version may come between
            names = [n for n in self._names("states") if n.endswith(".json")]
            try:
                return self._publish("states", int(names[-1][:-5]) + 1 if names else 1, {"states": states})
            except Conflict:
                continue
        raise Conflict(f"states of {self.base}")

    def frame(self) -> DataFrame:
        """The transitions in order of time."""
        return self.spark.createDataFrame([{k: h[k] for k in ("alert", "from", "to", "value", "message", "at")} for h in self.read()[1]], HISTORY)
