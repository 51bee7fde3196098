"""Facets: the values of fields over the newest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.vocab import level_name_col
from tracewell.operators.search import keys, newest, rows_between
from tracewell.plans.ast import Expr
from tracewell.plans.parser import QueryError
from tracewell.plans.view import View

#: Fields that come first, in this order, and the caps on what is listed.
WELL_KNOWN = ("level", "service", "environment", "name", "status", "exception.type")
MAX_FIELDS, MAX_TRACKED_FIELDS, MAX_TRACKED_VALUES, TOP_VALUES, SAMPLE = 64, 256, 200, 10, 2000


def _fixed(view: View) -> dict[str, Column]:
    c = view.columns
    out = {"service": c.get("service"), "environment": c.get("environment")}
    if view.signal == "logs":
        out |= {"level": level_name_col(c["level"]) if "level" in c else None, "exception.type": c.get("exception.type")}
    else:
        out |= {"name": c.get("message"), "status": c.get("status") if view.signal == "traces" else None}
    return {k: v for k, v in out.items() if v is not None}


_ENTRIES = "array<struct<field:string,pos:int,value:string>>"


def _entry(field: str, pos: int, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(pos).alias("pos"), value.cast("string").alias("value"))


def _elements(field: str, pos: int, values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda x: _entry(field, pos, x)), F.array().cast(_ENTRIES))


def facets(view: View, e: Expr | None = None, start: int | None = None, stop: int | None = None, sample: int = SAMPLE, top: int = TOP_VALUES, only: list[str] | None = None, with_sampled: bool = False) -> DataFrame:
    """Per listed value: rank (of the field), field, events (that have the field), truncated, value_rank, value, count; with_sampled also how many events were sampled.

    Counts over the `sample` newest matches, which is the feature: everything after the top-k works on that many rows.
    A field's events count once; each element of an array counts as a value. Null properties don't count.
    Fields beyond the first 256, and values of a field beyond the first 200, by when the newest-first walk meets
    them, are not tracked. Fields whose sampled events have no tracked value are not listed.
    """
    if only is not None and len(only) > MAX_FIELDS:
        raise QueryError(f"'fields' may name at most {MAX_FIELDS} fields")
    if view.attributes:
        # stored rows are wide: the sample's bounds are found first, at once, and then only its rows are read
        at = keys(view, e, start, stop, sample)
        newest_rows = rows_between(view, e, at[0], at[-1]).coalesce(1) if at else view.df.where(F.lit(False)).coalesce(1)
    else:
        newest_rows = newest(view, e, start, stop, sample).coalesce(1)
    order = Window.orderBy(view.columns["timestamp"].desc(), F.col("id").desc())
    rows = newest_rows.withColumn("_n", F.row_number().over(order))
    arrays = [F.array(_entry(k, i, v)) for i, (k, v) in enumerate(_fixed(view).items()) if only is None or k in only]
    if only is None or any(f not in WELL_KNOWN for f in only):
        for i, (path, (kind, col)) in enumerate(sorted(view.typed.items())):
            if only is None or path in only:
                arrays.append(_elements(path, 100 + i, col) if kind == "texts" else F.array(_entry(path, 100 + i, col)))
        if view.attributes and "leaf_list" in view.df.columns:
            # leaf_list: (path, text) of every scalar in document order, arrays walked
            leaf = F.transform("leaf_list", lambda x, k: F.struct(x["path"].alias("field"), (k + 1000).alias("pos"), x["text"].alias("value")))
            leaf = leaf if only is None else F.filter(leaf, lambda x: x["field"].isin(list(only)))
            arrays.append(F.coalesce(leaf, F.array().cast(_ENTRIES)))
    if not arrays:
        return view.df.sparkSession.createDataFrame([], "rank int, field string, events long, truncated boolean, value_rank int, value string, count long" + ", sampled long" * with_sampled)
    # one pass over the sample makes all (event, field, value) rows; the top-k has one partition, and all that follows stays in it
    found = rows.withColumn("sampled", F.count(F.lit(1)).over(Window.partitionBy())).select("sampled", "_n", F.explode(F.concat(*arrays)).alias("f"))
    found = found.select("sampled", "_n", "f.field", "f.pos", "f.value").where("value is not null")
    at = F.struct("_n", "pos")
    of_field = Window.partitionBy("field")
    found = found.withColumn("one", F.row_number().over(Window.partitionBy("field", "_n").orderBy("pos")) == 1)
    found = found.withColumn("events", F.count_if("one").over(of_field))
    values = found.groupBy("field", "value", "events", "sampled").agg(F.count("*").alias("count"), F.min(at).alias("first"))
    values = values.withColumn("met", F.min("first").over(of_field)).withColumn("k", F.row_number().over(of_field.orderBy("first"))).withColumn("all", F.count("*").over(of_field))
    values = values.withColumn("seen", F.dense_rank().over(Window.orderBy("met"))).where((F.col("seen") <= MAX_TRACKED_FIELDS) & (F.col("k") <= MAX_TRACKED_VALUES))
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(WELL_KNOWN) for x in (k, i)]), F.col("field")), F.lit(len(WELL_KNOWN)))
    values = values.withColumn("rank", F.dense_rank().over(Window.orderBy(place, F.desc("events"), "field"))).where(F.col("rank") <= MAX_FIELDS)
    values = values.withColumn("value_rank", F.row_number().over(of_field.orderBy(F.desc("count"), "value"))).where(F.col("value_rank") <= top)
    out = values.select("rank", "field", "events", (F.col("all") > top).alias("truncated"), "value_rank", "value", "count", *["sampled"] * with_sampled)
    return out.sortWithinPartitions("rank", "value_rank")
