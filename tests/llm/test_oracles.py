"""Corpus queries that SQL expresses give their DuckDB twins' rows at the smallest scale."""

import os

import duckdb
import pytest

from tideline.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TIDELINE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
