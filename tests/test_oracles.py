"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from cadastra.plans import panel_queries, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    columns, got = rows(registry.QUERIES[name](spark, SF).toPandas())
    wanted_columns, wanted = rows(con.sql(registry.ORACLES[name]).df())
    assert columns == wanted_columns
    assert got.equals(wanted)


GAPPY = {
    "lineitem": "SELECT * REPLACE (CASE WHEN (l_suppkey + year(l_shipdate)) % 4 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem WHERE (l_suppkey * 3 + year(l_shipdate)) % 7 <> 0",
    "orders": "SELECT * FROM orders WHERE year(o_orderdate) % 4 <> 1 AND (year(o_orderdate) % 3 <> 0 OR o_orderpriority = '1-URGENT')",
}


@pytest.fixture(scope="module")
def gappy(con, tmp_path_factory):
    """Tables in which units miss years and values, and years miss types or everything."""
    folder = tmp_path_factory.mktemp("gappy")
    c = duckdb.connect()
    for t, q in GAPPY.items():
        con.sql(f"COPY ({q}) TO '{folder}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", sorted(panel_queries.ORACLES))
def test_panel_query_equals_sql_with_gaps(spark, gappy, name):
    c, folder = gappy
    columns, got = rows(panel_queries.QUERIES[name](spark, folder).toPandas())
    wanted_columns, wanted = rows(c.sql(panel_queries.ORACLES[name]).df())
    assert columns == wanted_columns
    assert got.equals(wanted)
