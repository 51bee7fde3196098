"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a classifier learns from, of each label, and the longest text among them.
PER_LABEL = 4000
MAX_CHARS = 20_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no classifier learns from; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """(text, label) of per_label documents of each label at most, smallest hashes of the id first, none held out.

    The sample is bounded by per_label * 2 rows of max_chars each, so it may be brought to the driver,
    and its ids may be broadcast. Texts over max_chars and labels other than 0 and 1 are not learnt from; of two labels of an id the 1 counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(~held_out("id"))
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label) for y in (0, 1)]
    ids = some[0].union(some[1]).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(ids), "id").select("id", "text", "y").limit(4 * per_label).collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return [(r.text, r.y) for r in rows]
