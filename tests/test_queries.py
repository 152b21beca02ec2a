"""Every registered query against its SQL counterpart on the smallest tables."""


import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(value):
        if value is None or value is pd.NA or value != value:
            return None
        return value.item() if hasattr(value, "item") else value

    table = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(table, key=lambda row: tuple(map(str, row)))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
