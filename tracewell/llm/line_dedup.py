"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

Lines are cut, stripped, lower-cased and hashed (128 bits) in Arrow batches, where bytes.lower() touches just A-Z; only (hash, id)
pairs leave. They are aggregated with partial aggregates, so a line that a third of all documents share leaves each
map task as one row. The repeated hashes are written out; in the join of lines to them both sides are then plain shuffles,
which adaptive execution splits where a hash is hot. The dropped lines come back to their documents as positions; texts are
shuffled once, for that join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE, fresh, materialize

_LAST_ID = 2**63 - 1
_SPACE = SPACE.encode()


def line_keys(text: str) -> list[bytes]:
    r"""Of each line, \n ends them: the line without white space at its ends, A-Z lower-cased, as UTF-8."""
    return [k.strip(_SPACE) for k in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _hashed(min_chars: int):
    """Rows (row, id, text) to a row (row, id, pos, h) per line whose key has min_chars code points."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            of, pos, h = [], [], []
            for i, text in enumerate(b.column(2)):
                for p, k in enumerate(line_keys(text.as_py())):
                    if len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= min_chars):
                        of.append(i)
                        pos.append(p)
                        h.append(digest(k))
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(h, pa.binary())], names=["row", "id", "pos", "h"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    r"""docs with text_col replaced by its kept lines, and the counts n_lines and n_dropped added.

    Lines end at \n only; a null or empty text is one empty line and becomes ''. A key of at least min_chars code
    points that at least min_docs documents hold loses its lines everywhere but in the smallest
    id holding it, which keeps all of them. Rows with a null id count as one document with
    the largest id. Rows that repeat an id count as one document; each row keeps its own lines.
    All other columns pass through, whatever their names; if one is named like a new column, the new one gets underscores in front.
    """
    n_lines, n_dropped = fresh(docs, n_lines), fresh(docs, n_dropped)
    pos, row, own, at, of = (fresh(docs, f"line_{c}") for c in ("dropped", "row", "own", "row_of", "id_of"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID))
    # tells rows of one id apart
    key = F.xxhash64(own_id, text)
    lines = docs.select(key.alias("row"), own_id.alias("id"), text.alias("text")).mapInArrow(_hashed(min_chars), "row long, id long, pos int, h binary")
    if min_docs == 2:
        shared = lines.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    else:
        shared = lines.groupBy("h", "id").agg(F.lit(1).alias("one")).groupBy("h").agg(F.min("id").alias("first"), F.count("one").alias("n")).where(F.col("n") >= min_docs)
    shared = materialize(shared.select(F.col("h").alias("sh"), "first"), "repeated-lines")
    gone = lines.join(shared, (F.col("h") == F.col("sh")) & (F.col("id") != F.col("first")))
    gone = gone.groupBy("row", "id").agg(F.collect_set("pos").alias(pos)).select(F.col("row").alias(at), F.col("id").alias(of), pos)
    left = docs.select("*", key.alias(row), own_id.alias(own))
    joined = left.join(gone, (F.col(row) == F.col(at)) & (F.col(own) == F.col(of)), "left").drop(row, own, at, of)
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col(pos)), lambda i: F.get(parts, i))
    new_text = F.when(F.col(pos).isNull(), text).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col(pos).isNull(), F.lit(0)).otherwise(F.size(pos))
    made = {text_col: new_text, n_lines: n.cast("long"), n_dropped: dropped.cast("long")}
    return joined.withColumns(made).drop(pos)
