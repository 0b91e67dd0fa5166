"""Every registered query beside its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from bookflow.plans import load
from check_oracles import TABLES, _rows

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


CORE = load().QUERIES


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    got, names = _rows(df.columns, df.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    want, want_names = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert names == want_names
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_session_free_registry():
    assert set(CORE) <= set(entry.oracle_sql()) <= set(entry.queries())
