"""The corpus queries with SQL, row for row; every registered one at the smallest size."""
import duckdb
import pytest

from checks.compare import TABLES, differences
from tremorline.llm.oracles import ORACLES
from tremorline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    assert differences(QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith(("op11", "op12"))))
def test_one_row_each(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    rows, expected = QUERIES[name](spark, SF), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows.count() == expected
