"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tscausal import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v.isoformat()[:10] if hasattr(v, "isoformat") else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in frame.to_dict("records")), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, FOLDER).toArrow(), duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in mine.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert rows(mine.to_pandas()) == rows(theirs.to_pandas())


@pytest.mark.parametrize("name", ["iaaft_surrogates", "tree_grid_cv", "vif", "stepwise_aic"])
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in catalog.QUERIES
