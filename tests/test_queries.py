"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tracewell import queries, queries_store

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as db:
        for p in Path(DATA).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield db


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    one = Counter(tuple(map(plain, (r[c] for c in cols))) for r in got.collect())
    assert one == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.SQL.keys()


def _held(spark, folder, name):
    """The rows of a query and of its SQL on one thread, which takes the first row in the input where an order leaves several."""
    with duckdb.connect(config={"threads": 1}) as db:
        for p in Path(folder).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = db.execute(queries.SQL[name])
        cols = [d[0] for d in want.description]
        got = Counter(tuple(map(plain, (r[c] for c in cols))) for r in queries.QUERIES[name](spark, str(folder)).collect())
        return got, Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_trace_roots_of_one_id_and_time(spark, tmp_path):
    """Lines of one order, number and day, whose order is missing as 192 divides its key + 1: the first in the input is the root."""
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT * FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        line = "SELECT * REPLACE (191 AS l_orderkey, 1 AS l_linenumber, TIMESTAMP '1992-01-01' AS l_shipdate, {} AS l_suppkey) FROM (SELECT * FROM '{}/lineitem.parquet' LIMIT 1)"
        both = " UNION ALL ".join([f"SELECT * FROM '{DATA}/lineitem.parquet'", *(line.format(k, DATA) for k in (7, 3, 9))])
        db.execute(f"COPY ({both}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = _held(spark, tmp_path, "trace_summary")
    assert got == want
    assert [r[2] for r in got if r[0].endswith("c0") and int(r[0], 16) == 192] == ["supp-7"]


@pytest.mark.parametrize(
    "orders, lines",
    [
        ("", "l_quantity / 7 AS l_quantity"),
        ("", "CASE WHEN l_suppkey % 2 = 0 THEN l_quantity END AS l_quantity"),
        ("", "CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS l_suppkey"),
        ("", "CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate END AS l_shipdate"),
        ("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey", ""),
        ("CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice", ""),
    ],
    ids=["parts", "no quantity", "no supplier", "no day", "no customer", "no price"],
)
def test_trace_summary_of_values_that_are_missing_or_in_parts(spark, tmp_path, orders, lines):
    with duckdb.connect() as db:
        for t, change in (("orders", orders), ("lineitem", lines)):
            cols = f"* REPLACE ({change})" if change else "*"
            db.execute(f"COPY (SELECT {cols} FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = _held(spark, tmp_path, "trace_summary")
    assert got == want


def test_trace_summary_of_whole_large_traces(spark, tmp_path):
    """Traces of over 10,000 spans: the first's order is later than its lines and yet the root; the second's is missing, as 192 divides its key + 1."""
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT * REPLACE (CASE o_orderkey WHEN 7 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS o_orderdate) FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        line = "SELECT l.* REPLACE ({} AS l_orderkey, TIMESTAMP '1992-01-01' + INTERVAL 1 HOUR * i AS l_shipdate, 1000 + i // 10500 AS l_suppkey, CASE WHEN i < 10500 THEN 'A' ELSE 'R' END AS l_returnflag) FROM (SELECT * FROM '{}/lineitem.parquet' LIMIT 1) l, range(11000) t(i)"
        both = " UNION ALL ".join([f"SELECT * FROM '{DATA}/lineitem.parquet' WHERE l_orderkey NOT IN (7, 191)", *(line.format(k, DATA) for k in (7, 191))])
        db.execute(f"COPY ({both}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = _held(spark, tmp_path, "trace_summary")
    assert got == want
    large = {int(r[0], 16) - 1: r for r in got if r[5] > 10_000}
    assert large[7][1] != "ship" and large[7][5] == 11_001 and large[7][7] == 500
    assert large[191][1] == "ship" and large[191][5] == 11_000 and large[191][6] == "supp-0,supp-1"


def _events(folder, change):
    with duckdb.connect() as db:
        db.execute(f"COPY (SELECT * REPLACE ({change}) FROM '{DATA}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")


def test_panel_needs_only_logs_and_any_ids(spark, tmp_path):
    """Ids that don't begin at 0 are appended too; orders and lineitems, which the panel's SQL doesn't read, aren't even there."""
    _events(tmp_path, "event_id * 3 + 1000 AS event_id")
    got, want = _held(spark, tmp_path, "panel_log_count")
    assert got == want and next(iter(got))[0] > 0
    got, want = _held(spark, tmp_path, "store_ids")
    assert got == want


@pytest.mark.parametrize("sign", ["", "-"])
def test_compaction_of_quarters_that_begin_on_several_days(spark, tmp_path, sign):
    """One quarter has a day before the others': the day that all four have is compacted, whatever day their files would begin on."""
    _events(tmp_path, f"TIMESTAMP '2024-01-02' + INTERVAL 1 MINUTE * event_id - CASE WHEN event_id = 8 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS ts, {sign}event_id AS event_id")
    got, want = _held(spark, tmp_path, "store_compaction")
    assert got == want
