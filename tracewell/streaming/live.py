"""Streams: appending micro-batches to the store, live tail, and alerts over a sliding window."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.alerts import CONDITIONS, FIRING, OK, Alert
from tracewell.operators.limits import Busy
from tracewell.plans.ast import Expr
from tracewell.plans.compiler import predicate
from tracewell.plans.parser import parse
from tracewell.plans.view import View
from tracewell.sources import schema
from tracewell.sources.columns import record_batch
from tracewell.sources.table import ROTATE_SECS, Manifest, SignalTable

#: Events that a subscriber gets of a batch, batches that one may be behind, and what a trigger and an inbox take in at most.
MAX_PER_BATCH, MAX_BEHIND = 200, 64
MAX_FILES, MAX_WAITING = 1000, 100_000


def file_source(spark: SparkSession, path: str, max_files: int = MAX_FILES, max_bytes: str | None = None) -> DataFrame:
    """Request bodies from the lines of files as they come, at most so many files (and bytes) a trigger: what is over waits in the folder."""
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.text(path)


@dataclass
class Inbox:
    """Events of several requests that go into one commit. A request that would make more than `most` wait is refused as a whole."""

    table: SignalTable
    most: int = MAX_WAITING
    waiting: list[dict] = field(default_factory=list)
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def submit(self, events: list[dict]) -> int:
        """How many wait now; the events are visible after the next flush."""
        with self.lock:
            if len(self.waiting) + len(events) > self.most:
                raise Busy()
            self.waiting += events
            return len(self.waiting)

    def flush(self) -> Manifest:
        """Appends all that wait in one commit; if it fails they wait on."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        with self.lock:
            some, self.waiting = self.waiting, []
        if not some:
            return self.table.manifest()
        kind = StructType.fromDDL(schema.columns(self.table.signal))
        try:
            return self.table.append(self.table.spark.createDataFrame(pa.Table.from_batches([record_batch(some, to_arrow_schema(kind))]), kind))
        except BaseException:
            with self.lock:
                self.waiting = some + self.waiting
            raise


@dataclass(frozen=True)
class Lag:
    """How far a stream is: its last batch, the rows in that, batches or files that wait, and whether that is too many."""

    batch: int
    rows: int
    waiting: int
    lagging: bool


def _offset(x) -> dict:
    """An offset of a progress report: JSON, or a dictionary as Python prints it."""
    try:
        return json.loads(x.replace("'", '"')) if isinstance(x, str) else x or {}
    except ValueError:
        return {}


def lag(query: StreamingQuery, most: int = MAX_BEHIND) -> Lag | None:
    """From the query's last progress; None before the first."""
    p = query.lastProgress
    if p is None:
        return None
    waiting = 0
    for source in p["sources"]:
        ends = [source.get(k) for k in ("latestOffset", "endOffset")]
        latest, end = map(_offset, ends)
        if isinstance(latest, dict) and isinstance(end, dict):
            waiting += max(0, latest.get("logOffset", 0) - end.get("logOffset", 0))
    return Lag(p["batchId"], p["numInputRows"], waiting, waiting > most)


def ingest_stream(bodies: DataFrame, decode: Callable[[DataFrame], DataFrame], table: SignalTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch once: the store knows the batches that it has, so one that is replayed after a failure adds nothing.

    Late events are appended like any other; only retention goes by time. The checkpoint names the stream's batches. Without a trigger what is there is taken in and
    the query ends; a query that goes on commits every ROTATE_SECS with trigger(processingTime=rotation()).
    """
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder")

    def write(batch: DataFrame, number: int) -> None:
        table.append(decode(batch), f"{checkpoint}#{number}")

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rotation(seconds: int = ROTATE_SECS) -> str:
    return f"{seconds} seconds"


@dataclass
class Tail:
    """What a subscriber gets: per batch the first rows by (time, id), and how many more there were."""

    send: Callable[[list, int], None]
    most: int = MAX_PER_BATCH
    batches: int = 0
    dropped: int = 0
    query: StreamingQuery | None = field(default=None, repr=False)

    def deliver(self, rows: DataFrame, number: int) -> None:
        kept = rows.orderBy("ts_ns", "id").limit(self.most + 1).collect()
        over = 0
        if len(kept) > self.most:
            over = rows.count() - self.most
        self.batches += 1
        self.dropped += over
        if kept:
            self.send(kept[: self.most], over)

    def lag(self) -> Lag | None:
        return None if self.query is None else lag(self.query)

    def close(self) -> None:
        if self.query is not None:
            self.query.stop()


def tail(view: View, send: Callable[[list, int], None], query: str | Expr | None = None, checkpoint: str | None = None, most: int = MAX_PER_BATCH, **trigger) -> Tail:
    """Follows a streaming view with a filter. Spark replays from its offsets after a failure, so a slow subscriber lags but loses nothing."""
    e = parse(query) if isinstance(query, str) else query
    rows = view.df if e is None else view.df.where(predicate(e, view))
    t = Tail(send, most)
    writer = rows.writeStream.foreachBatch(t.deliver)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    t.query = writer.trigger(**(trigger or {"availableNow": True})).start()
    return t


def alert_stream(view: View, alert: Alert, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The alert's count and status for each window that ends on its interval: a streaming sliding count with a watermark.

    view's rows need a timestamp column. A window without matches has no row, so conditions that an empty
    window meets need the polling evaluation.
    """
    alert.validate()
    e = parse(alert.query)
    rows = view.df if e is None else view.df.where(predicate(e, view))
    slide = min(alert.interval_secs, alert.window_secs)
    windows = F.window(F.col(ts), f"{alert.window_secs} seconds", f"{slide} seconds")
    counted = rows.withWatermark(ts, late).groupBy(windows.alias("w")).agg(F.count("*").cast("double").alias("value"))
    value, limit = F.col("value"), alert.threshold
    firing = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "=": value == limit, "!=": value != limit}[alert.op]
    assert alert.op in CONDITIONS
    return counted.select(F.lit(alert.name).alias("alert"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", F.when(firing, FIRING).otherwise(OK).alias("status"))


def changes(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes what each batch changes of a streaming aggregate, with the batch's number. State goes as the watermark passes, and nothing gathers in the driver."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    update = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return update.trigger(**(trigger or {"availableNow": True})).start()


def newest_of(written: DataFrame, *keys: str) -> DataFrame:
    """The last of each key's rows that changes() wrote."""
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
