"""Every registered query with a DuckDB twin gives the twin's rows at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tideline.operators import extensions as X
from tideline.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TIDELINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_joins_and_table_functions_over_whole_tables(spark):
    """By brute force: every order, customer, supplier and range takes part."""
    rows = {t: [r.asDict() for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()] for t in ("customer", "supplier", "orders", "part")}
    names = {c["c_custkey"]: c["c_name"] for c in rows["customer"]}
    suppliers = {s["s_suppkey"] for s in rows["supplier"]}
    want = {
        "ext_join_right_all": [(o["o_orderkey"], names.get(o["o_custkey"])) for o in rows["orders"]],
        "ext_join_full_all": [(c if c in names else None, c if c in suppliers else None) for c in names.keys() | suppliers],
        "ext_join_range_all": [(p["p_partkey"], r["p_size"]) for p in rows["part"] for r in rows["part"] if r["p_size"] <= p["p_retailprice"] % 60 < r["p_size"] + 5],
        "ext_udtf_all": [(o["o_orderkey"], x) for o in rows["orders"] for x in o["o_orderpriority"].split("-")],
    }
    for name, pairs in want.items():
        assert sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=str) == sorted(pairs, key=str), name


def test_range_join_deals_its_pairs_out(spark, monkeypatch):
    """Equal ranges count as often as they occur, also beyond one row's copies; no task has more than a small part of the pairs."""
    monkeypatch.setattr(X, "COPIES", 7)
    low = [0.0] * 50 + [1.5] * 8 + [3.0] + [None] * 2
    points = spark.range(400, numPartitions=1).selectExpr("id", "if(id % 10 = 9, null, id % 10 / 2) as x")
    ranges = spark.createDataFrame([(v, None if v is None else v + 2) for v in low], "lo double, hi double").coalesce(1)
    got = X.range_join(points, ranges, "x", "lo", "hi", 2).withColumn("task", F.spark_partition_id()).collect()
    want = [(i, v) for i in range(400) if i % 10 != 9 for v in low if v is not None and v <= i % 10 / 2 < v + 2]
    assert sorted((r.id, r.lo) for r in got) == sorted(want)
    assert max(sum(r.task == k for r in got) for k in range(200)) < len(want) / 4


@pytest.fixture
def dealt(spark):
    """Small tables go to as many tasks as large ones and are not broadcast."""
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_of_large_groups_are_dealt_out(spark, dealt, monkeypatch, tmp_path):
    """Ties, NULLs, a group of one row and one of nearly all, over many bins: plain windows say the same, and no task gets a group."""
    monkeypatch.setattr(X, "BIN", 7, raising=False)
    columns = ["id as o_orderkey", "case when id = 5 then 'P' when id % 50 = 3 then null else 'F' end as o_orderstatus", "if(id % 9 = 0, null, id % 41) as o_custkey", "if(id % 11 = 0, null, if(id % 7 = 0, double('nan'), id % 4 / 2)) as o_totalprice"]
    spark.range(600).selectExpr(*columns).write.parquet(f"{tmp_path}/orders.parquet")
    w, w2 = "(partition by o_orderstatus order by o_totalprice, o_orderkey)", "(partition by o_orderstatus order by o_custkey)"
    names = {"rn": f"row_number() over {w}", "rk": f"rank() over {w2}", "dr": f"dense_rank() over {w2}", "nt": f"ntile(4) over {w}", "pr": f"round(percent_rank() over {w2}, 6)", "cd": f"round(cume_dist() over {w2}, 6)"}
    want = spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("o_orderkey", *[f"{v} as {k}" for k, v in names.items()])
    df = QUERIES["ext_window_rank"](spark, str(tmp_path))
    assert df.dtypes == want.dtypes
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r[:-1] for r in got) == sorted(map(tuple, want.collect()))
    assert max(sum(r.task == k for r in got) for k in range(200)) < 150


def test_running_sums_take_a_few_bins_into_a_task(spark, dealt, monkeypatch):
    monkeypatch.setattr(X, "BIN", 10, raising=False)
    rows = spark.range(500).selectExpr("id", "if(id < 3, id, null) as g", "id * 37 % 500 as t")
    got = X.running_sums(rows, ["g"], ["t"], {"n": F.lit(1), "s": F.col("id")}, 500).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 500
    for r in got:
        peers = [x for x in got if x.g == r.g]
        assert (r.n, r.s, r.n_all, r.s_all) == (sum(x.t <= r.t for x in peers), sum(x.id for x in peers if x.t <= r.t), len(peers), sum(x.id for x in peers))
    assert max(sum(r.task == k for r in got) for k in range(200)) < 125
    assert not X.running_sums(rows.where("id < 0"), ["g"], ["t"], {"n": F.lit(1)}, 0).collect()


def test_entry_imports_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "tideline.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not [n for n in entry.queries() if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    sys.modules.pop("__spark_entry__")
