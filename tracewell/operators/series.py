"""Time histograms and metric series over dense, epoch-aligned buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.limits import MAX_POINTS, ResultLimit
from tracewell.plans.ast import Comparison, Expr, conjunction
from tracewell.plans.compiler import matching
from tracewell.plans.parser import QueryError
from tracewell.plans.view import View

MS = 1_000_000
DAY_MS = 86_400_000
#: Bucket widths that people like, in milliseconds.
NICE_STEPS_MS = (1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000, 900_000, 1_800_000, 3_600_000, 7_200_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000, 172_800_000, 604_800_000)
AGGREGATES = ("sum", "count", "min", "max", "avg", "last")
MAX_GROUPS = 20
OTHER, NONE = "(other)", "(none)"


def choose_step_ms(start: int, stop: int, max_buckets: int) -> int:
    """The first nice width that needs no more than about max_buckets; beyond the widest, whole days."""
    want = max(1, (stop - start) // MS) // max(1, max_buckets)
    return next((s for s in NICE_STEPS_MS if s >= want), (want // DAY_MS + 1) * DAY_MS)


def grid(start: int, stop: int, step_ms: int) -> tuple[int, int, int]:
    """(first bucket, step, number of buckets) in nanoseconds. The first bucket may begin before start."""
    step = max(1, step_ms) * MS
    first = start // step * step
    return first, step, max(1, -(-(stop - first) // step))


def check_points(start: int, stop: int, step_ms: int, what: str = "buckets") -> None:
    if grid(start, stop, step_ms)[2] > MAX_POINTS:
        raise ResultLimit(what, MAX_POINTS, "use a larger step or a shorter time range")


def bucket(ts: Column, step: int) -> Column:
    return ts - F.pmod(ts, F.lit(step))


def histogram(view: View, e: Expr | None, start: int, stop: int, buckets: int = 60, step_ms: int | None = None, levels: bool | None = None) -> DataFrame:
    """bucket (ns), count, and for logs levels: counts of [none, Trace, ... Fatal]. Empty buckets are there."""
    step_ms = step_ms or choose_step_ms(start, stop, buckets)
    check_points(start, stop, step_ms)
    first, step, n = grid(start, stop, step_ms)
    with_levels = view.signal == "logs" if levels is None else levels
    aggs = [F.count(F.lit(1)).alias("count")]
    if with_levels:
        code = F.coalesce(view.columns["level"].cast("int"), F.lit(0)) if "level" in view.columns else F.lit(0)
        aggs += [F.count_if(code == k).alias(f"level_{k}") for k in range(7)]
    found = matching(view, e, start, stop).groupBy(bucket(view.columns["timestamp"], step).alias("bucket")).agg(*aggs)
    # at most MAX_POINTS groups come out of the aggregate, whatever went in: they and the grid are one partition each
    all_ = view.df.sparkSession.range(0, n, 1, 1).select((F.lit(first) + F.col("id") * F.lit(step)).alias("bucket"))
    out = all_.join(found.coalesce(1).hint("merge"), "bucket", "left").sortWithinPartitions("bucket")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    cols = ["bucket", zero("count").alias("count")]
    return out.select(*cols, *([F.array(*(zero(f"level_{k}") for k in range(7))).alias("levels")] if with_levels else []))


def _points(view: View) -> dict[str, Column]:
    """What a data point adds: s (sum), c (count), mn, mx, last, as numbers or histograms have it."""
    number = view.columns["value"]
    finite = F.when(F.abs(number) < float("inf"), number)
    if "hist" not in view.df.columns:
        return {"s": finite, "c": F.when(finite.isNotNull(), 1.0), "mn": finite, "mx": finite, "last": finite}
    h = F.col("hist")
    is_h = h.isNotNull()
    total, n = F.coalesce(h["sum"], F.lit(0.0)), h["count"].cast("double")
    mean = F.when(n > 0, total / n).otherwise(0.0)
    return {
        "s": F.when(is_h, total).otherwise(finite),
        "c": F.when(is_h, n).when(finite.isNotNull(), 1.0),
        "mn": F.when(is_h, F.coalesce(h["min"], mean)).otherwise(finite),
        "mx": F.when(is_h, F.coalesce(h["max"], mean)).otherwise(finite),
        "last": F.when(is_h, mean).otherwise(finite),
    }


def _metric_rows(view: View, name: str, e: Expr | None, start: int, stop: int) -> DataFrame:
    if not name.strip():
        raise QueryError("'metric' is required")
    return matching(view, conjunction(Comparison("name", "=", name), e), start, stop)


def metric_series(view: View, name: str, start: int, stop: int, agg: str = "avg", step_ms: int | None = None, group_by: str | None = None, e: Expr | None = None, max_points: int = 120) -> DataFrame:
    """group (null if ungrouped), bucket (ns), value; every bucket of every group, null where it has no points.

    The first MAX_GROUPS values of the property, by the (time, id) of their first point, keep their name; the others are
    '(other)', points without the property '(none)'. Only properties group, not well-known fields.
    Groups are ranked on one row each, after a partial aggregate; the dense grid has at most 21 x MAX_POINTS rows.
    """
    if agg not in AGGREGATES:
        raise QueryError(f"'agg' must be one of {', '.join(AGGREGATES)}")
    step_ms = step_ms if step_ms and step_ms >= 1000 else choose_step_ms(start, stop, max_points)
    check_points(start, stop, step_ms, "points")
    first, step, n = grid(start, stop, step_ms)
    rows = _metric_rows(view, name, e, start, stop)
    ts = view.columns["timestamp"]
    key = F.coalesce(view.text_of(group_by), F.lit(NONE)) if group_by else F.lit(None).cast("string")
    points = _points(view)
    rows = rows.select(key.alias("g"), bucket(ts, step).alias("bucket"), F.struct(ts.alias("ts"), F.col("id").alias("id")).alias("at"), *(c.alias(k) for k, c in points.items()))
    # one row per group and bucket: all further steps work on those
    part = rows.groupBy("g", "bucket").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.max(F.when(F.col("last").isNotNull(), F.struct("at", "last"))).alias("lst"), F.min("at").alias("seen"))
    if group_by:
        order = part.groupBy("g").agg(F.min("seen").alias("seen")).orderBy("seen").limit(MAX_GROUPS)
        named = order.select(F.col("g").alias("kept"))
        part = part.join(F.broadcast(named), F.col("g") == F.col("kept"), "left").withColumn("g", F.coalesce("kept", F.lit(OTHER)))
    value = {"sum": F.sum("s"), "count": F.sum("c"), "min": F.min("mn"), "max": F.max("mx"), "avg": F.when(F.sum("c") > 0, F.sum("s") / F.sum("c")), "last": F.max("lst")["last"]}[agg]
    found = part.groupBy("g", "bucket").agg(value.cast("double").alias("value"))
    # at most 21 groups of n buckets, in one partition; each bucket also stands for the empty ones up to the next
    found = found.coalesce(1)
    per = Window.partitionBy("g").orderBy("bucket")
    start = F.when(F.lag("bucket").over(per).isNull(), F.lit(first)).otherwise(F.col("bucket"))
    stop = F.coalesce(F.lead("bucket").over(per), F.lit(first + n * step)) - F.lit(step)
    dense = found.select("g", "value", "bucket", start.alias("a"), stop.alias("b"))
    dense = dense.select(F.col("g").alias("group"), F.explode(F.sequence("a", "b", F.lit(step))).alias("at"), "bucket", "value")
    out = dense.select("group", F.col("at").alias("bucket"), F.when(F.col("at") == F.col("bucket"), F.col("value")).alias("value"))
    return out.sortWithinPartitions(F.col("group").asc_nulls_first(), "bucket")


def metric_meta(view: View, name: str, start: int, stop: int, e: Expr | None = None) -> DataFrame:
    """unit, kind and description of the first matching point; no row if there is none."""
    rows = _metric_rows(view, name, e, start, stop)
    have = {c: (F.col(c) if c in view.df.columns else F.lit(None).cast("string")).alias(k) for c, k in (("unit", "unit"), ("metric_kind", "kind"), ("description", "description"))}
    best = rows.agg(F.min_by(F.struct(*have.values()), F.struct(view.columns["timestamp"], F.col("id"))).alias("m"))
    return best.where("m is not null").select("m.*")


def metric_names(view: View, most: int = 1000) -> DataFrame:
    """Distinct names in order, and whether there were more than `most`."""
    names = view.df.select(view.columns["message"].alias("name")).where("name is not null").distinct()
    ranked = names.orderBy("name").limit(most + 1).withColumn("n", F.row_number().over(Window.orderBy("name"))).withColumn("all", F.count("*").over(Window.partitionBy()))
    return ranked.where(F.col("n") <= most).select("name", (F.col("all") > most).alias("truncated"))
