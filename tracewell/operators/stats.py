"""Statistics of fields, and of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per numeric column: present, min, max and an approximate distinct count, in one pass over df."""
    aggs = []
    for i, f in enumerate(fields):
        x = F.col(f)
        aggs += [F.count(x).alias(f"c{i}"), F.min(x.cast("double")).alias(f"a{i}"), F.max(x.cast("double")).alias(f"b{i}"), F.approx_count_distinct(x, 0.05).alias(f"d{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("present"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"), F.col(f"d{i}").alias("distinct")) for i, f in enumerate(fields)))
    return one.select(F.inline(rows))


def property_stats(df: DataFrame, attributes: str = "attr") -> DataFrame:
    """Per property path of a stored table: events that have it, the kinds of its values, least and greatest number, distinct texts."""
    found = df.select(F.explode(attributes).alias("path", "p")).where("p.kind <> 'null'")
    leaf = F.explode_outer("p.leaves")
    flat = found.select("path", "p.kind", leaf.alias("l"))
    stats = flat.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("l.num").alias("min"), F.max("l.num").alias("max"), F.approx_count_distinct("l.txt").alias("distinct"))
    return stats.join(found.groupBy("path").agg(F.count("*").alias("present")), "path")
