"""Every registered query against its SQL, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(rows, columns):
    def cell(x):
        return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else x

    return sorted(
        (tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr
    )


@pytest.mark.parametrize("name", list(contract.core_queries()))
def test_query_equals_sql(spark, sql, name):
    found = contract.queries()[name](spark, SF_DIR)
    wanted = sql.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal([tuple(r) for r in found.collect()], found.columns) == normal(wanted.fetchall(), columns)


def test_every_query_has_sql():
    assert set(contract.core_queries()) == set(contract.core_sql())
