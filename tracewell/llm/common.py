"""What the training-data operators share: reading, naming, cutting lineage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.scratch import delete, new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of every contract here: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of df has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


_WRITTEN: list[str] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder, and read from there.

    It cuts lineage, so a lost executor costs a re-read and not a recomputation, and unlike
    checkpoint() it keeps column pruning for the readers. The folder goes when the session ends, or when passed_on() has what was made from it.
    """
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passed_on(make: Callable[[], DataFrame], tag: str, read: str | None = None) -> tuple[DataFrame, str]:
    """What make() gives, written out, and its path. Tables that it wrote on the way, and the one at `read` that it was made from, are deleted then."""
    before = len(_WRITTEN)
    df = materialize(make(), tag)
    spark, path = df.sparkSession, _WRITTEN.pop()
    for gone in [*_WRITTEN[before:], *([read] if read else [])]:
        delete(spark, gone)
    del _WRITTEN[before:]
    return df, path


def slices(sizes, most_bytes: int):
    """(from, to) over rows so that each slice holds most_bytes at most, or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary file of a public tokenizer lies; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
