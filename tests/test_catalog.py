"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = os.environ.get("VEILSCAN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def norm(v):
    return repr(v + 0.0) if isinstance(v, float) else str([norm(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry_module.catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    duck.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in duck.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in duck.fetchall())


def test_contexts_of_all_scripts_are_cut(spark, duck):
    rows = duck.execute("SELECT finding_id, context FROM findings WHERE context IS NOT NULL").fetchall()
    want = sorted((i, c.encode()[:97].decode("utf-8", "replace") + "..." if len(c.encode()) > 100 else c) for i, c in rows)
    assert any("\ufffd..." in c for _, c in want)
    assert sorted(map(tuple, entry_module.queries()["truncated_findings"](spark, DATA).collect())) == want


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
