"""The registered training-data queries on the smallest tables, against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()  # noqa: F841
    sql.sql(f"CREATE OR REPLACE TEMP TABLE o AS {ORACLES[name]}")
    sql.register("got", got)
    sql.sql("CREATE OR REPLACE TEMP TABLE r AS SELECT * FROM got")
    cols = ", ".join(sorted(c[0] for c in sql.sql("DESCRIBE o").fetchall()))
    for a, b in (("o", "r"), ("r", "o")):
        assert sql.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []


def test_all_thirteen_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
