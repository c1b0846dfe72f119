"""Every query with an SQL counterpart, at the smallest scale."""
from pathlib import Path

import pytest

from checks.compare import TABLES, differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert differences(QUERIES[name](spark, str(DATA)).toPandas(), db.sql(ORACLES[name]).df()) is None


def test_flagship(spark):
    import __spark_entry__ as contract

    ranked = contract.entry(spark).toPandas()
    assert len(ranked) == 103 + 93 + 91
    assert (ranked[ranked["repo"] != "repo0"]["risk_score"] == 50.0).all()
    assert contract.queries().keys() >= contract.oracle_sql().keys()
