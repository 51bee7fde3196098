"""The store: a Parquet table per signal with a manifest of its files.

Layout under a root on any file system Spark reaches: <signal>/data/<commit>/*.parquet, <signal>/manifest/<version>.json, and
<signal>/days/<name>.json. Files are sorted by (ts_ns, id); a large batch is dealt to files by time. A version is small: it names a list of files per day that they begin in, with the
list's times, rows and bytes; the lists never change, so a commit writes those of the days it touches, and a query loads those of the days
in its range. A commit writes the next version under a name of its own and renames it: of two writers one fails, and tries again on
what the other committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators.limits import Budget, Diagnostics, UnknownSignal
from tracewell.operators.search import Cursor, keys, rows_between
from tracewell.plans.ast import Expr
from tracewell.plans.view import SIGNALS, View
from tracewell.sources import schema

DAY_NS = 86_400 * 10**9
#: Defaults: how long signals are kept, when small files are put together, and how large files become.
RETENTION_DAYS = {"logs": 30, "traces": 14, "metrics": 30}
TARGET_BYTES, COMPACT_BYTES, COMPACT_FILES = 64 << 20, 32 << 20, 4
ROTATE_ROWS, ROTATE_BYTES, ROTATE_SECS = 2_000_000, 64 << 20, 300
BLOOM = {"logs": ("trace_id",), "traces": ("trace_id", "span_id"), "metrics": ("message",)}
#: Unnamed-stream batches that are remembered, tries of a commit, versions that stay for readers, and hours until what no commit names is deleted.
BATCHES, TRIES, VERSIONS, ORPHAN_HOURS = 500, 5, 20, 24


@dataclass(frozen=True)
class File:
    path: str
    min_ts: int
    max_ts: int
    min_id: int
    max_id: int
    rows: int
    bytes: int
    raw_bytes: int

    def overlaps(self, start: int | None, stop: int | None) -> bool:
        return (start is None or self.max_ts >= start) and (stop is None or self.min_ts < stop)


@dataclass(frozen=True)
class Day:
    """A day's list of files by its name, and what can be told without reading it."""

    name: str
    files: int
    rows: int
    bytes: int
    raw_bytes: int
    min_ts: int
    max_ts: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 1
    days: dict[int, Day] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)  # of each stream the last batch appended
    batches: tuple[str, ...] = ()  # the last batches of no stream
    retired: tuple[str, ...] = ()  # replaced or expired, still on disk
    load: Callable[[Manifest], list[File]] | None = field(default=None, repr=False, compare=False)

    @property
    def files(self) -> tuple[File, ...]:
        """All files, from the lists of all days."""
        return tuple(self.load(self)) if self.load else ()

    def saved(self) -> dict[str, Any]:
        return {"version": self.version, "next_id": self.next_id, "days": {d: asdict(v) for d, v in self.days.items()}, "streams": self.streams, "batches": self.batches, "retired": self.retired}

    def has(self, batch: str | None) -> bool:
        name, _, number = (batch or "").rpartition("#")
        return batch is not None and (int(number) <= self.streams.get(name, -1) if name and number.isdigit() else batch in self.batches)

    def with_batch(self, batch: str | None) -> Manifest:
        name, _, number = (batch or "").rpartition("#")
        if name and number.isdigit():
            return replace(self, streams={**self.streams, name: int(number)})
        return self if batch is None else replace(self, batches=(*self.batches, batch)[-BATCHES:])


class Conflict(RuntimeError):
    """Another writer committed first."""


class JsonFolder:
    """JSON files that are written once, under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self._jvm = spark, base, spark._jvm
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._known: dict[str, Any] = {}  # files, which never change, and frames over files

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.base}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _keep(self, key: str, make: Callable[[], Any], most: int = 200) -> Any:
        if key not in self._known:
            if len(self._known) >= most:
                self._known.clear()
            self._known[key] = make()
        return self._known[key]

    def _load(self, name: str) -> Any:
        def read():
            stream = self._fs.open(self._path(f"{self.base}/{name}"))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

        return self._keep(name, read)

    def _save(self, name: str, value: Any) -> None:
        out = self._fs.create(self._path(f"{self.base}/{name}"), False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()

    def _publish(self, folder: str, version: int, value: Any) -> None:
        """Writes the version under a name of its own and renames it; Conflict if there is one. The last VERSIONS stay for readers."""
        final, draft = f"{folder}/{version:012d}.json", f"{folder}/.{uuid.uuid4().hex}"
        self._save(draft, value)
        paths = [self._path(f"{self.base}/{n}") for n in (draft, final)]
        if self._fs.exists(paths[1]) or not self._fs.rename(*paths):
            self._fs.delete(paths[0], False)
            raise Conflict(f"version {version} of {self.base} is taken")
        for name in self._names(folder):
            if name.endswith(".json") and int(name[:-5]) <= version - VERSIONS:
                self._fs.delete(self._path(f"{self.base}/{folder}/{name}"), False)

    def _newest(self, folder: str) -> Any:
        names = [n for n in self._names(folder) if n.endswith(".json")]
        return self._load(f"{folder}/{names[-1]}") if names else None


class SignalTable(JsonFolder):
    def __init__(self, spark: SparkSession, root: str, signal: str):
        if signal not in SIGNALS:
            raise UnknownSignal(f"unknown signal '{signal}'")
        super().__init__(spark, f"{root.rstrip('/')}/{signal}")
        self.signal, self.schema = signal, StructType.fromDDL(schema.table(signal))

    # --- manifest ---

    def manifest(self) -> Manifest:
        raw = self._newest("manifest")
        if raw is None:
            return Manifest()
        return Manifest(raw["version"], raw["next_id"], {int(d): Day(**v) for d, v in raw["days"].items()}, raw["streams"], tuple(raw["batches"]), tuple(raw["retired"]), lambda m: self.files(manifest=m))

    def files(self, start: int | None = None, stop: int | None = None, manifest: Manifest | None = None) -> list[File]:
        """The files that the range touches; only the lists of its days are read."""
        days = (manifest or self.manifest()).days.values()
        hit = [d for d in days if (start is None or d.max_ts >= start) and (stop is None or d.min_ts < stop)]
        return [f for d in hit for f in (File(**x) for x in self._load(f"days/{d.name}.json")) if f.overlaps(start, stop)]

    def _with_files(self, m: Manifest, added: Iterable[File], gone: Iterable[File]) -> Manifest:
        """m with the lists of the days that files come to or go from written anew."""
        added, lost = list(added), {f.path for f in gone}
        days = dict(m.days)
        for day in {f.min_ts // DAY_NS for f in (*added, *gone)}:
            old = [File(**x) for x in self._load(f"days/{days[day].name}.json")] if day in days else []
            files = [f for f in old if f.path not in lost] + [f for f in added if f.min_ts // DAY_NS == day]
            days.pop(day, None)
            if files:
                name = uuid.uuid4().hex
                self._save(f"days/{name}.json", [asdict(f) for f in files])
                days[day] = Day(name, len(files), *(sum(getattr(f, k) for f in files) for k in ("rows", "bytes", "raw_bytes")), min(f.min_ts for f in files), max(f.max_ts for f in files))
        return replace(m, days=days, retired=m.retired + tuple(sorted(lost)))

    def _commit(self, m: Manifest) -> Manifest:
        m = replace(m, version=m.version + 1)
        self._publish("manifest", m.version, m.saved())
        return m

    def _change(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Commits what change makes of the newest version; again on the next one if another writer was first. None commits nothing."""
        for k in range(TRIES):
            m = self.manifest()
            new = change(m)
            if new is None:
                return m
            try:
                return self._commit(new)
            except Conflict:
                if k + 1 == TRIES:
                    raise
                time.sleep(0.05 * 2**k)
        raise AssertionError

    # --- writing ---

    def _write(self, df: DataFrame, folder: str, file_rows: int) -> tuple[File, ...]:
        """Files of df in the folder, one per partition, sorted by (ts_ns, id), of ROTATE_ROWS rows at most; file_rows: about how many rows one has, for the size of its bloom filters.

        Bytes before compression are summed while writing; of what was written only the times and ids are read back.
        """
        names = [n for n in self.schema.names if n != "date"]
        raw = F.coalesce(F.length("message") + F.length("attributes_json") + F.length("resource_json"), F.lit(0)) + 40
        seen = Observation()
        ready = df.select(*names).observe(seen, F.sum(raw).alias("raw"), F.count(F.lit(1)).alias("rows")).sortWithinPartitions("ts_ns", "id")
        writer = ready.write.option("compression", "zstd").option("maxRecordsPerFile", ROTATE_ROWS)
        for c in BLOOM[self.signal]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(min(ROTATE_ROWS, max(100, file_rows))))
        writer.parquet(folder)
        total = seen.get
        per_row = (total["raw"] or 0) / max(1, total["rows"])
        back = self.spark.read.schema("ts_ns long, id long").parquet(folder)
        stats = back.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"), F.min("id").alias("c"), F.max("id").alias("d"), F.count("*").alias("n"))
        return tuple(File(r["path"], r["a"], r["b"], r["c"], r["d"], r["n"], r["size"], round(per_row * r["n"])) for r in stats.collect())

    def _folder(self, kind: str = "data") -> str:
        return f"{self.base}/{kind}/{uuid.uuid4().hex}"

    def _by_part(self, rows: DataFrame, parts: int, part: Column) -> DataFrame:
        """Rows dealt to exactly the partition that part says, so that no file holds two parts."""
        return rows.repartitionById(parts, part.cast("int"))

    def append(self, events: DataFrame, batch: str | None = None, by_day: bool = False) -> Manifest:
        """Adds events (without ids) in the order they have; ids follow on from the last one, and none is given twice.

        A batch that was appended before changes nothing: of a stream (name#number) the last number is kept for good, of other names the
        last BATCHES. The rows are staged first, so that the ids are given to
        rows that no longer change; per partition one number, its row count, is brought to the driver. If another writer's append comes first the rows
        are written again under the next ids; if its commit was of another kind, only the commit is made again. With by_day each day's rows go to files of their own.
        """
        m = self.manifest()
        if m.has(batch):
            return m
        staged, folder, based = self._folder("staging"), "", -1
        files: tuple[File, ...] = ()
        try:
            events.withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
            rows = self.spark.read.parquet(staged)
            part = F.shiftright("_at", 33)
            counts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
            size = self._fs.getContentSummary(self._path(staged)).getLength()
            day = F.expr(f"(ts_ns - pmod(ts_ns, {DAY_NS})) div {DAY_NS}")
            days = sorted(r["d"] for r in rows.select(day.alias("d")).distinct().collect()) if by_day else []

            def change(now: Manifest) -> Manifest | None:
                nonlocal files, folder, based
                if now.has(batch) or not counts and batch is None:
                    return None
                last = now.next_id
                if counts and based != now.next_id:
                    if folder:
                        self._fs.delete(self._path(folder), True)
                    folder, based, starts = self._folder(), now.next_id, []
                    for r in counts:
                        starts.append((r["p"], last))
                        last += r["n"]
                    table = self.spark.createDataFrame(starts, "p long, base long")
                    ready = rows.join(F.broadcast(table), part == F.col("p")).withColumn("id", F.col("base") + F.col("_at").bitwiseAND((1 << 33) - 1))
                    parts = len(days) or max(1, -(-size // ROTATE_BYTES))
                    if parts == 1:
                        ready = ready.coalesce(1)
                    elif days:
                        ready = self._by_part(ready, parts, F.array_position(F.array(*map(F.lit, days)), day) - 1)
                    else:
                        ready = ready.repartitionByRange(parts, "ts_ns")
                    files = self._write(ready, folder, sum(r["n"] for r in counts) // parts)
                return replace(self._with_files(now.with_batch(batch), files, ()), next_id=now.next_id + sum(r["n"] for r in counts))

            done = self._change(change)
        except BaseException:
            if folder:
                self._fs.delete(self._path(folder), True)
            raise
        finally:
            self._fs.delete(self._path(staged), True)
        if folder and based + sum(r["n"] for r in counts) > done.next_id:  # another writer had the batch
            self._fs.delete(self._path(folder), True)
        return done

    def compact(self, target: int = TARGET_BYTES, most: int = COMPACT_BYTES) -> int:
        """Puts small files (under a quarter of target) of each day together, oldest first, up to `most` bytes a day, all days in one job; how many were replaced."""
        small: dict[int, list[File]] = {}
        for f in sorted(self.files(), key=lambda f: (f.min_ts, f.min_id)):
            group = small.setdefault(f.min_ts // DAY_NS, [])
            if f.bytes < target // 4 and sum(x.bytes for x in group) + f.bytes <= most:
                group.append(f)
        old = [f for g in small.values() if len(g) >= COMPACT_FILES for f in g]
        if not old:
            return 0
        groups = {day: k for k, day in enumerate(sorted({f.min_ts // DAY_NS for f in old}))}
        rows = self._scan([f.path for f in old])
        if len(groups) > 1:
            of = self.spark.createDataFrame([(f.path, groups[f.min_ts // DAY_NS]) for f in old], "path string, part int")
            rows = self._by_part(rows.join(F.broadcast(of), F.col("_metadata.file_path") == F.col("path")), len(groups), F.col("part"))
        folder = self._folder()
        new = self._write(rows if len(groups) > 1 else rows.coalesce(1), folder, sum(f.rows for f in old) // len(groups))

        def change(now: Manifest) -> Manifest | None:
            have = {f.path for f in self.files(manifest=now)}
            return self._with_files(now, new, old) if all(f.path in have for f in old) else None  # some expired meanwhile

        before = self.manifest().version
        if self._change(change).version == before:
            self._fs.delete(self._path(folder), True)
            return 0
        return len(old)

    def expire(self, now_ns: int, days: int | None = None) -> int:
        """Drops files whose newest event is older than the retention; how many."""
        cutoff = now_ns - (RETENTION_DAYS[self.signal] if days is None else days) * DAY_NS
        old: list[File] = []

        def change(m: Manifest) -> Manifest | None:
            old[:] = [f for f in self.files(stop=cutoff, manifest=m) if f.max_ts < cutoff]
            return self._with_files(m, (), old) if old else None

        self._change(change)
        return len(old)

    def vacuum(self, orphan_hours: float = ORPHAN_HOURS) -> int:
        """Deletes retired files, and what writers that died have left; to be called when no reader of an older version is left. How many retired files."""
        gone: tuple[str, ...] = ()

        def change(m: Manifest) -> Manifest | None:
            nonlocal gone
            gone = m.retired
            return replace(m, retired=()) if gone else None

        m = self._change(change)
        for path in gone:
            self._fs.delete(self._path(path), False)
        cutoff = (time.time() - 3600 * orphan_hours) * 1000
        used = {"data": {f.path.split("/data/")[-1].split("/")[0] for f in self.files(manifest=m)}, "staging": set(), "days": {f"{d.name}.json" for d in m.days.values()}}
        for kind, names in used.items():
            for name in set(self._names(kind)) - names:
                path = self._path(f"{self.base}/{kind}/{name}")
                if self._fs.getFileStatus(path).getModificationTime() < cutoff:
                    self._fs.delete(path, True)
        return len(gone)

    # --- reading ---

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType([f for f in self.schema.fields if f.name != "date"])).parquet(*paths)

    def _read(self, files) -> DataFrame:
        paths = [f.path for f in files]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
        return self._keep("\n".join(paths), lambda: self._scan(paths).withColumn("date", day).select(*self.schema.names))

    def _view(self, files) -> View:
        return replace(View.stored(self.signal, self._read(files)), date=None)

    def view(self, start: int | None = None, stop: int | None = None, budget: Budget | None = None, manifest: Manifest | None = None) -> View:
        """The rows of the files that the range touches, as of now; their bytes are charged to the budget first."""
        files = self.files(start, stop, manifest)
        if budget:
            budget.charge(sum(f.bytes for f in files))
        return self._view(files)

    def diagnose(self, start: int | None = None, stop: int | None = None, manifest: Manifest | None = None) -> Diagnostics:
        m = manifest or self.manifest()
        hit, total = self.files(start, stop, m), sum(d.files for d in m.days.values())
        return Diagnostics(total, total - len(hit), len(hit), sum(f.bytes for f in hit), sum(f.rows for f in hit))

    def latest(self, e: Expr | None = None, start: int | None = None, stop: int | None = None, limit: int = 200, cursor: Cursor | None = None, forward: bool = False, budget: Budget | None = None, manifest: Manifest | None = None) -> tuple[list[Any], Diagnostics]:
        """The newest matches (with forward the oldest), reading files in that order and stopping when no other file can hold one that comes before those found.

        Files are taken in growing groups, so that a rare filter costs a few jobs and not one per file. Only files that are read are charged.
        """
        if cursor is not None:
            start, stop = (cursor.ts if start is None else max(start, cursor.ts), stop) if forward else (start, cursor.ts + 1 if stop is None else min(stop, cursor.ts + 1))
        m = manifest or self.manifest()
        first = (lambda f: (f.min_ts, f.min_id)) if forward else (lambda f: (-f.max_ts, -f.max_id))
        files = sorted(self.files(start, stop, m), key=first)
        best: list[tuple[int, int]] = []
        read, step = 0, 1
        while read < len(files):
            if len(best) >= limit:
                edge = files[read]
                if forward and (edge.min_ts, edge.min_id) > best[-1] or not forward and (edge.max_ts, edge.max_id) < best[-1]:
                    break
            while e is None and read + step < len(files) and sum(f.rows for f in files[read : read + step]) < limit - len(best):
                step += 1
            group = files[read : read + step]
            if budget:
                budget.charge(sum(f.bytes for f in group))
            best = sorted(best + keys(self._view(group), e, start, stop, limit, cursor, forward), reverse=not forward)[:limit]
            read += len(group)
            step *= 4
        done, total = files[:read], sum(d.files for d in m.days.values())
        rows: list[Any] = []
        if best:  # whole rows only of those, from the files that hold them
            low, high = min(best), max(best)
            held = [f for f in done if f.max_ts >= low[0] and f.min_ts <= high[0]]
            rows = sorted(rows_between(self._view(held), e, low, high).collect(), key=lambda r: (r["ts_ns"], r["id"]), reverse=not forward)
        return rows, Diagnostics(total, total - read, read, sum(f.bytes for f in done), sum(f.rows for f in done), len(rows))

    def stats(self) -> dict[str, Any]:
        """Of the whole table, from the version alone."""
        days = self.manifest().days.values()
        stored, raw = sum(d.bytes for d in days), sum(d.raw_bytes for d in days)
        return {
            "signal": self.signal, "files": sum(d.files for d in days), "events": sum(d.rows for d in days), "bytes": stored, "rawBytes": raw,
            "compressionRatio": raw / stored if stored else None, "oldest": min((d.min_ts for d in days), default=None), "newest": max((d.max_ts for d in days), default=None),
        }


class Store:
    """The tables of all signals under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = {s: SignalTable(spark, root, s) for s in SIGNALS}

    def __getitem__(self, signal: str) -> SignalTable:
        if signal not in self.tables:
            raise UnknownSignal(f"unknown signal '{signal}'")
        return self.tables[signal]

    def ingest(self, signal: str, rows: list[dict] | DataFrame, spark: SparkSession | None = None, batch: str | None = None) -> Manifest:
        if not isinstance(rows, DataFrame):
            rows = self[signal].spark.createDataFrame(rows, StructType.fromDDL(schema.columns(signal)))
        return self[signal].append(rows, batch)

    def maintain(self, now_ns: int) -> dict[str, tuple[int, int]]:
        """(files expired, files compacted) of each signal."""
        return {s: (t.expire(now_ns), t.compact()) for s, t in self.tables.items()}

    def stats(self) -> list[dict[str, Any]]:
        return [t.stats() for t in self.tables.values()]


__all__ = ["Conflict", "Day", "File", "Manifest", "SignalTable", "Store"]
