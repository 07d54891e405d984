import os

import duckdb
import pytest

from fleetlens.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(sql.ORACLES[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
