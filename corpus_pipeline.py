"""Documents to packed training sequences: five stages, each over all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import fresh, passed_on, table
from tracewell.llm.line_dedup import dedup_lines
from tracewell.llm.minhash import drop_near
from tracewell.llm.mixing import in_mix_order
from tracewell.llm.packing import pack
from tracewell.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labels of documents that are not held out."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text. A document may become empty but stays."""
    names = {k: fresh(docs, k) for k in ("n_lines", "n_dropped")}
    out = dedup_lines(docs, **names).drop(*names.values())
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return in_mix_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a worker packs neighbours of the mix."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Classification and hashing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Each stage's rows are written before the next one reads them, so each runs once, and deleted when that one has read them."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = passed_on(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"), path)
    return STAGES[-1][1](spark, docs, sf_dir)
