"""Relational tables seen as telemetry: each function gives the View of one signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.view import View

#: Event types as levels: click is Trace, view Debug, signup Information, purchase Warning, error Error.
TYPE_LEVELS = {"click": 1, "view": 2, "signup": 3, "purchase": 4, "error": 5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def place(table: int) -> Column:
    """Where a row stands in the input, to tell rows apart that have the same id; table: its place among tables that are put together."""
    return F.struct(F.lit(table).alias("table"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")


def _columns(**where: str) -> dict[str, Column]:
    return {k: F.col(v) for k, v in where.items()}


def logs(spark: SparkSession, sf_dir: str) -> View:
    return logs_of(read(spark, sf_dir, "events"))


def logs_of(e: DataFrame) -> View:
    level = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_LEVELS.items() for x in kv]), F.col("event_type"))
    environment = F.when(F.col("user_id") % 5 == 0, None).when(F.col("user_id") % 3 == 0, "staging").otherwise("production")
    df = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), ns(F.col("ts")).alias("ts_ns"), level.alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")).alias("service"), environment.alias("environment"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string")).alias("message"),
        hex_id(F.col("event_id") % 1000 + 1, 32).alias("trace_id"), F.col("user_id"), F.col("value"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.array(F.col("event_type"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string"))).alias("tags"),
    )
    typed = {"userId": ("int", F.col("user_id")), "value": ("num", F.col("value")), "k": ("int", F.col("k")), "tags": ("texts", F.col("tags")), "kind": ("text", F.col("event_type"))}
    return View("logs", df, _columns(timestamp="ts_ns", level="level", service="service", environment="environment", message="message", traceId="trace_id"), typed, ts="ts")


def documents(spark: SparkSession, sf_dir: str) -> View:
    d = read(spark, sf_dir, "documents")
    df = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ts_ns"), F.col("text").alias("message"), F.col("source").alias("service"), F.col("lang").alias("environment"), "n_chars")
    return View("logs", df, _columns(timestamp="ts_ns", message="message", service="service", environment="environment"), {"nChars": ("int", F.col("n_chars"))})


def spans(spark: SparkSession, sf_dir: str) -> View:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")

    def common(key: Column, line: Column) -> list[Column]:
        n = (key + 1) * 100 + line
        return [n.alias("id"), hex_id(key + 1, 32).alias("trace_id"), hex_id(n, 16).alias("span_id")]

    roots = o.select(
        *common(F.col("o_orderkey"), F.lit(0)), none.alias("parent_span_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("name"),
        F.concat(F.lit("shop-"), (F.col("o_custkey") % 4).cast("string")).alias("service"), F.floor(F.col("o_totalprice").cast("double") * 1000).cast("bigint").alias("duration_ns"), F.lit("Unset").alias("status"), F.lit("Server").alias("span_kind"), place(0),
    )
    status = F.when(F.col("l_returnflag") == "R", "Error").when(F.col("l_returnflag") == "A", "Ok").otherwise("Unset")
    lines = li.select(
        *common(F.col("l_orderkey"), F.col("l_linenumber")), hex_id((F.col("l_orderkey") + 1) * 100, 16).alias("parent_span_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("ship").alias("name"),
        F.concat(F.lit("supp-"), (F.col("l_suppkey") % 10).cast("string")).alias("service"), F.rint(F.col("l_quantity").cast("double") * 1_000_000).cast("bigint").alias("duration_ns"), status.alias("status"), F.lit("Client").alias("span_kind"), place(1),
    )
    df = roots.unionByName(lines).withColumn("ts_ns", ns(F.col("ts"))).withColumn("duration_ms", F.col("duration_ns") / 1e6)
    names = _columns(timestamp="ts_ns", message="name", service="service", traceId="trace_id", spanId="span_id", parentSpanId="parent_span_id", durationMs="duration_ms", status="status", spanKind="span_kind")
    return View("traces", df, names, ts="ts")


def metrics(spark: SparkSession, sf_dir: str) -> View:
    e = read(spark, sf_dir, "events")
    df = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), ns(F.col("ts")).alias("ts_ns"), F.concat(F.lit("events."), F.col("event_type")).alias("name"),
        F.col("value"), F.lit("gauge").alias("metric_kind"), F.lit("1").alias("unit"), F.col("event_type").alias("description"), F.col("user_id"),
    )
    return View("metrics", df, _columns(timestamp="ts_ns", message="name", value="value", unit="unit", metricKind="metric_kind"), {"user": ("int", F.col("user_id"))}, ts="ts")


def histograms(spark: SparkSession, sf_dir: str) -> View:
    """A histogram point per order: how many lines, and the sum, least and greatest of their quantities."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    per = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.sum(q).alias("s"), F.min(q).alias("mn"), F.max(q).alias("mx"))
    df = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"), ns(F.col("o_orderdate")).alias("ts_ns"), F.col("o_orderstatus")).join(per, "id")
    hist = F.struct(F.col("n").cast("decimal(20,0)").alias("count"), F.col("s").alias("sum"), F.col("mn").alias("min"), F.col("mx").alias("max"))
    df = df.select("id", "ts", "ts_ns", F.lit("order.lines").alias("name"), F.lit(None).cast("double").alias("value"), hist.alias("hist"), F.col("o_orderstatus").alias("order_status"))
    return View("metrics", df, _columns(timestamp="ts_ns", message="name", value="value"), {"status": ("text", F.col("order_status"))}, ts="ts")
