"""Every registered query against its DuckDB oracle on the smallest test tables
(the driver runs the same comparison at sf0.01); rows-only queries must run."""

import os

import duckdb
import pytest

from tools.oracle_check import digest
from vocalframe.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _names():
    import __spark_entry__ as E
    return sorted(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    res = con.sql(sql)
    assert sorted(df.columns) == sorted(res.columns)
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(res.columns, orows)[0]
