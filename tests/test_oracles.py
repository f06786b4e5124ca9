"""Every query that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from motifmill.jobs.catalogue import QUERIES
from motifmill.jobs.oracle import ORACLE_SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def listed(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: "-" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = sql.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want)
    assert listed(got) == listed(want)
