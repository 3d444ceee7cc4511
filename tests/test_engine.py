import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.errors import EngineError
from tideline.plans import changelog as C
from tideline.plans.engine import Engine

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("grp", T.StringType()), T.StructField("v", T.LongType())])
VIEWS = {
    "f": ("select id, v * 2 as w from s where v > 10", "select id, v * 2 from s where v > 10"),
    "a": ("select grp, sum(v) as sv, count(*) as n from s group by grp having sum(v) > 50", "select grp, sum(v), count(*) from s group by grp having sum(v) > 50"),
    "u": ("select id, v from s where v < 20 union all select w, id from f", "select id, v from s where v < 20 union all select v * 2, id from s where v > 10"),
    "c": ("select count(*) as c, sum(sv) as t from a", "select count(*), sum(sv) from (select sum(v) as sv from s group by grp having sum(v) > 50)"),
    "m": ("select grp, min(v) as lo, max(v) as hi from s group by grp", "select grp, min(v), max(v) from s group by grp"),
    "d": ("select distinct grp from s", "select distinct grp from s"),
}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_views_equal_their_query_over_the_latest_rows(spark, tmp_path, batches):
    rnd = random.Random(batches)
    e = Engine(spark, str(tmp_path / "e"), buckets=3)
    e.create_source("s", SCHEMA, ["id"])
    for name in ("f", "a", "u", "c", "m"):
        e.create_view(name, VIEWS[name][0])
    now = {}
    for b in range(batches):
        rows = [(rnd.randint(0, 12), rnd.choice([None, "x", "y"]), rnd.choice([None, *range(40)]), i, rnd.random() < 0.1) for i in range(20)]
        for r in rows:
            now.pop(r[0], None)
            if not r[4]:
                now[r[0]] = r[:3]
        df = spark.createDataFrame(rows, "id bigint, grp string, v bigint, q int, gone boolean")
        for _ in range(2):  # the second time is a replay
            e.ingest("s", df, b, ["q"], deleted="gone")
    e.create_view("d", VIEWS["d"][0])  # filled from what is there
    spark.createDataFrame(list(now.values()), SCHEMA).createOrReplaceTempView("s")
    assert rows_of(e.read("s")) == rows_of(spark.table("s"))
    for name, (_, sql) in VIEWS.items():
        want = rows_of(spark.sql(sql))
        if name == "c" and want == [(0, None)]:
            want = []  # no row before the first input
        assert rows_of(e.read(name)) == want, name


def test_catalog_survives_a_restart(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.create_source("s", SCHEMA, ["id"])
    e.create_view("n", "select grp, count(*) as n from s group by grp")
    e.ingest("s", spark.createDataFrame([(1, "x", 1), (2, "x", 2)], SCHEMA), 0)
    again = Engine(spark, str(tmp_path / "e"))
    again.ingest("s", spark.createDataFrame([(9, "x", 1)], SCHEMA), 0)  # seen before the restart
    again.ingest("s", spark.createDataFrame([(3, "x", 1)], SCHEMA), 1)
    assert rows_of(again.read("n")) == [("x", 3)]


def test_replay_after_a_commit_that_was_lost(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "e"))
    e.create_source("s", SCHEMA, ["id"])
    e.create_view("n", "select grp, sum(v) as n from s group by grp")
    e.ingest("s", spark.createDataFrame([(1, "x", 1)], SCHEMA), 0)
    monkeypatch.setattr(e, "_propagate", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    batch = spark.createDataFrame([(1, "x", 5), (2, "x", 7)], SCHEMA)
    with pytest.raises(RuntimeError):
        e.ingest("s", batch, 1)
    again = Engine(spark, str(tmp_path / "e"))
    again.ingest("s", batch, 1)
    assert rows_of(again.read("n")) == [("x", 12)]


def test_filter_truth_table(spark):
    struct = "struct<v: bigint>"
    df = spark.createDataFrame([("both", (9,), (8,)), ("out", (9,), (1,)), ("in", (1,), (9,)), ("none", (1,), (2,)), ("null", None, (None,)), ("new", None, (9,))], f"k string, prev {struct}, curr {struct}")
    got = {r.k: (r.prev is not None, r.curr is not None) for r in C.filtered(df, "v > 5").collect()}
    assert got == {"both": (True, True), "out": (True, False), "in": (False, True), "new": (False, True)}


def test_empty_groups_and_zero_sums(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), zero_sum=True, keep_empty=True)
    e.create_source("s", SCHEMA, ["id"])
    e.create_view("n", "select grp, sum(v) as t, count(*) as n from s group by grp")
    e.ingest("s", spark.createDataFrame([(1, "x", None), (2, "y", 4)], SCHEMA), 0)
    e.ingest("s", spark.createDataFrame([(2, "x", 4)], SCHEMA), 1)
    assert rows_of(e.read("n")) == [("x", 4, 2), ("y", 0, 0)]


def test_null_keys_and_children_are_refused(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.create_source("s", SCHEMA, ["id"])
    e.create_view("v", "select id from s")
    with pytest.raises(EngineError, match="children"):
        e.drop("s")
    with pytest.raises(Exception, match="E2001"):
        e.ingest("s", spark.createDataFrame([(None, "x", 1)], SCHEMA), 0)
    for bad in ("select id from s order by id", "select id from s limit 3", "select id from nope"):
        with pytest.raises(EngineError):
            e.create_view("w", bad)


def test_initial_state(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    e.create_source("s", SCHEMA, ["id"])
    e.ingest("s", spark.createDataFrame([(1, "x", 1)], SCHEMA), 0)
    e.create_source("t", SCHEMA, ["id"], initial_state="s")
    assert rows_of(e.read("t")) == [(1, "x", 1)]


PUT = [("k", 'meta("key").k0'), ("v", "v")]


def test_sink_sends_the_last_row_of_each_key(spark, tmp_path):
    from tideline.streaming.runner import sink_messages

    e, sent = Engine(spark, str(tmp_path / "e")), []
    send = lambda df, b: sent.append({bytes(r.key).decode(): r.value and bytes(r.value).decode() for r in sink_messages(df, PUT).collect()})
    e.create_source("s", SCHEMA, ["id"])
    e.create_sink("k", "select id as k, v from s where v > 1", send, max_rows=4)
    e.ingest("s", spark.createDataFrame([(1, "x", 5), (2, "x", 6)], SCHEMA), 0)
    e.ingest("s", spark.createDataFrame([(1, "x", 7), (2, "x", 0)], SCHEMA), 1)
    assert sent == [{'{"k0":1}': '{"v":7}'}]  # the second row came and went before anything was sent
    e.ingest("s", spark.createDataFrame([(1, "x", 0)], SCHEMA), 2)
    again = Engine(spark, str(tmp_path / "e"))  # what waits survives a restart
    again.sink_writers["k"] = send
    again.ingest("s", spark.createDataFrame([(3, "x", 9)], SCHEMA), 3)
    assert sent[1:] == []
    again.emit_due()  # not due
    again.emit_due(now=True)
    assert sent[1:] == [{'{"k0":1}': None, '{"k0":3}': '{"v":9}'}]
    with pytest.raises(EngineError):
        e.create_sink("a", "select count(*) from s")


def test_layers_merge_and_old_ones_go(spark, tmp_path, monkeypatch):
    from tideline.plans import store

    monkeypatch.setattr(store, "KEPT", 2)
    e = Engine(spark, str(tmp_path / "e"), buckets=1)
    e.create_source("s", SCHEMA, ["id"])
    for b in range(12):
        e.ingest("s", spark.createDataFrame([(b % 5, "x", b), (100 + b, "y", b)], SCHEMA), b)
    want = [(i, "x", max(b for b in range(12) if b % 5 == i)) for i in range(5)] + [(100 + b, "y", b) for b in range(12)]
    assert rows_of(e.read("s")) == sorted(want, key=str)
    assert len(e.store("s").manifest()["layers"]["0"]) <= store.LAYERS + 1
    assert len(list((tmp_path / "e/tables/s").glob("[bm]*"))) <= store.LAYERS + 4
    assert not list((tmp_path / "e/changes").glob("*"))


def test_a_batch_writes_no_more_as_the_table_grows(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), buckets=2)
    e.create_source("s", SCHEMA, ["id"])
    e.ingest("s", spark.range(50_000).selectExpr("id", "'x' as grp", "id as v"), 0)
    e.ingest("s", spark.createDataFrame([(7, "y", 1)], SCHEMA), 1)
    first, second = e.store("s").files.size(f"{tmp_path}/e/tables/s/b1"), e.store("s").files.size(f"{tmp_path}/e/tables/s/b2")
    assert second * 20 < first
    assert e.read("s").where("id = 7").first().grp == "y" and e.read("s").count() == 50_000


TWO = {"u": ("select id, v from a union all select id, v from b", "select id, v from a union all select id, v from b"), "m": ("select grp, sum(v) as t, max(v) as hi from a group by grp", "select grp, sum(v), max(v) from a group by grp")}


@pytest.mark.parametrize("fails_at", [0, 1, 2, 4, 6, 8, 11])
def test_a_crash_at_any_write(spark, tmp_path, monkeypatch, fails_at):
    """The n-th write of a batch fails; another source's batch comes first, then the replay, in a new engine."""
    from tideline.plans import engine, store

    e = Engine(spark, str(tmp_path / "e"), buckets=1)
    for s in "ab":
        e.create_source(s, SCHEMA, ["id"])
    for name, (sql, _) in TWO.items():
        e.create_view(name, sql)
    batches = [[(1, "x", 3), (2, "y", 4)], [(1, "y", 9), (3, "x", 1)], [(1, "x", 7)]]
    e.ingest("a", spark.createDataFrame(batches[0], SCHEMA), 0)
    left, plain, numbered = [fails_at], store.dealt, store.Versions.write

    def counted(f):
        def run(*args):
            left[0] -= 1
            if left[0] < 0:
                raise OSError("lost")
            return f(*args)

        return run

    with monkeypatch.context() as m:
        for at in (store, engine):
            m.setattr(at, "dealt", counted(plain))
        m.setattr(store.Versions, "write", counted(numbered))
        try:
            e.ingest("a", spark.createDataFrame(batches[1], SCHEMA), 1)
        except OSError:
            pass
    again = Engine(spark, str(tmp_path / "e"), buckets=1)
    again.ingest("b", spark.createDataFrame(batches[2], SCHEMA), 0)
    again.ingest("a", spark.createDataFrame(batches[1], SCHEMA), 1)
    spark.createDataFrame([(1, "y", 9), (2, "y", 4), (3, "x", 1)], SCHEMA).createOrReplaceTempView("a")
    spark.createDataFrame(batches[2], SCHEMA).createOrReplaceTempView("b")
    for name, (_, sql) in TWO.items():
        assert rows_of(again.read(name)) == rows_of(spark.sql(sql)), name


def test_two_sources_at_once(spark, tmp_path):
    import threading

    e = Engine(spark, str(tmp_path / "e"), buckets=1)
    for s in "ab":
        e.create_source(s, SCHEMA, ["id"])
    e.create_view("u", "select id, v from a union all select id, v from b")
    run = lambda s: [e.ingest(s, spark.createDataFrame([(i, "x", i)], SCHEMA), i) for i in range(3)]
    threads = [threading.Thread(target=run, args=(s,)) for s in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows_of(e.read("u")) == sorted([(i, i) for i in range(3)] * 2)


def test_keys_differ_by_microseconds(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), buckets=1)
    e.create_source("s", T.StructType([T.StructField("t", T.TimestampType()), T.StructField("v", T.LongType())]), ["t"])
    rows = spark.sql("select timestamp'2020-01-01 00:00:00.123456' as t, 1L as v union all select timestamp'2020-01-01 00:00:00.123999', 2L")
    e.ingest("s", rows, 0)
    assert sorted(r.v for r in e.read("s").collect()) == [1, 2]


def test_two_engines_cannot_write_one_folder(spark, tmp_path):
    from tideline.plans.store import Files, Versions

    v = Versions(Files(spark), str(tmp_path / "v"))
    v.write("one")
    stale = [(0, "")]
    v._numbers = lambda: stale
    with pytest.raises(EngineError, match="another engine"):
        v.write("two")


def test_common_types():
    from tideline.types import common_type

    assert common_type(T.LongType(), T.TimestampType()) == T.StringType()
    assert common_type(T.ByteType(), T.LongType()) == T.LongType()
    assert common_type(T.DecimalType(10, 2), T.IntegerType()) == T.DecimalType(12, 2)
    assert common_type(T.DecimalType(10, 2), T.DoubleType()) == T.DoubleType()


def test_rounding_and_ranges(spark):
    from tideline.types import ColumnType, coerced, rounded

    df = spark.sql("select timestamp'2020-01-01 00:00:00.123456' as t, '300' as s, 1577836800123 as ms")
    assert df.select(rounded(F.col("t"), 3)).first()[0].microsecond == 123000
    assert df.select(coerced(F.col("ms"), T.LongType(), ColumnType.parse("timestamp(6)"))).first()[0].microsecond == 123000
    with pytest.raises(Exception, match="E2000"):
        df.select(coerced(F.col("s"), T.StringType(), ColumnType.parse("tinyint"))).collect()
    for bad in ("decimal(39,1)", "decimal(5,6)", "timestamp(7)", "blob"):
        with pytest.raises(EngineError):
            ColumnType.parse(bad)
