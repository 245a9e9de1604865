"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidewheel.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_kernel_queries_run_and_agree_with_themselves(spark, name):
    first = registry.QUERIES[name](spark, DATA).collect()
    assert first and sorted(map(repr, first)) == sorted(map(repr, registry.QUERIES[name](spark, DATA).repartition(3).collect()))


def test_entry_guard():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
