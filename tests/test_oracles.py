"""Every registered analytics query against its SQL in DuckDB, on tables with every kind of row."""

import duckdb
import pytest

from tellal.plans import registry

DATA = "/root/testdata/sf0.01"
TABLES = ["nation", "events", "documents", "orders", "lineitem", "customer"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracles()))
def test_rows_are_the_same(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    expected = duck.sql(registry.oracles()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    own = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = sorted(str(tuple(r[expected.columns.index(c)] for c in columns)) for r in expected.fetchall())
    assert own == theirs


def test_scan_of_documents_reads_every_row(spark):
    row = registry.queries()["documents_numbers"](spark, DATA).first()
    assert row["n_sentences"] > 200
