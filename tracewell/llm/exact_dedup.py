"""Exact dedup, DataFrame functions only.

Texts are grouped by a 128-bit content hash together with the bytes themselves: the hash
deals the rows out, and rows of a hash are compared byte by byte as grouping keys, so two
texts that share a hash stay two groups. The count and the id that stays are partial
aggregates: a group that holds a third of all rows leaves each map task as one row.
The decision goes back to the rows by (128-bit hash, SHA-256), narrow keys, in a
left join whose skewed partitions adaptive execution splits; texts cross the network once
per distinct text and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, fresh


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    keep: 'min' keeps the smallest id of a group, 'max' the largest.
    Null texts count as empty. A null id never stays unless its whole group has none; then
    keep_id is null and the rows count as kept. Rows that repeat an id and a text are
    rows of one group and, if the id is the one that stays, all kept. Other columns are
    not read, whatever their names. An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm"))
    rows = rows.select("id", "norm", content_hash(F.col("norm")).alias("h"))
    same = rows.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n"), (F.min if keep == "min" else F.max)("id").alias("keep_id"))
    groups = same.where("n > 1").select("h", F.sha2("norm", 256).alias("sha"), "n", "keep_id")
    narrow = rows.select("id", "h", F.sha2("norm", 256).alias("sha"))
    g = groups.select(F.col("h").alias("gh"), F.col("sha").alias("gsha"), "n", "keep_id")
    joined = narrow.join(g, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha")), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs, all columns, without the rows whose text another row keeps. Ids are unique here."""
    gone = exact_groups(docs, id_col, text_col, keep).where(~F.col("kept")).select(F.col(id_col).alias(key := fresh(docs, "gone_id")))
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
