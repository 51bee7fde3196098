"""The queries of the training-data operators that have SQL give the rows that DuckDB gives, on whole tables and on odd ones."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tracewell.llm import queries

DATA = Path("/root/testdata/sf0.001/documents.parquet")
ODD = [
    (1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo\n"), (5, "É a b c d e f g h"), (6, "é a b c d e f g h"), (7, "a b c d e f g h i j k l m n o"),
    (8, "a b c d e f g h i j k l m n p"), (9, "a b c d e f g h i j k l m n\x0bP  "), (10, "x" * 576), (11, "é" * 16 * 288), (12, "y " * 9216), (13, " \t\n"),
]


@pytest.fixture(scope="module", params=["given", "odd"])
def sf_dir(request, tmp_path_factory):
    if request.param == "given":
        return str(DATA.parent)
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in ODD], pa.int64()), "text": pa.array([t for _, t in ODD], pa.string())}), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        want = db.execute(queries.oracle_sql()[name])
        cols = [d[0] for d in want.description]
        rows = want.fetchall()
    assert sorted(cols) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(rows)
