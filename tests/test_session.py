import pytest

from tideline.errors import EngineError
from tideline.session import Session
from tideline.sources.selectors import parse_selector

SOURCE = """create source pay(payment_id varchar, customer bigint, amount decimal(10, 2), currency varchar, fraud double, ts timestamp(6), primary key (payment_id)) with (
  brokername = "b", topicname = "t", headerencoding = "stringbytes", keyencoding = "json", valueencoding = "json",
  columnselectors = (meta("key").payment_id, customer_id, amount, currency, meta("header").fraud_score, meta("timestamp")))"""


def fed(spark, folder, total=120, rate=50):
    s = Session(spark, str(folder / "s"), buckets=2)
    s.execute(SOURCE)
    s.execute("create materialized view by_cur as select currency, sum(amount) as total, count(*) as n from pay group by currency")
    s.execute(f"source set max rate pay {rate}")
    q = s.start("pay", s.messages("pay", "generator", {"name": "payments", "total": str(total)}), str(folder / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    return s


def test_a_source_can_wait_for_its_first_view(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"), buckets=2)
    s.execute(SOURCE.replace('topicname = "t"', 'topicname = "t", startwithfirstmv = true'))
    assert s.start("pay", s.messages("pay", "generator", {"name": "payments", "total": "10"}), str(tmp_path / "c")) is None
    s.execute("create materialized view n as select count(*) as n from pay")
    q = s.streams[("default", "pay")]
    q.processAllAvailable()
    q.stop()
    assert s.execute("select n from n").first().n == 10


def test_statements(spark, tmp_path):
    s = fed(spark, tmp_path)
    assert [(r.currency, r.n) for r in s.execute("select * from by_cur order by currency").collect()] == [(c, 30) for c in ("aud", "eur", "gbp", "usd")]
    got = s.execute("select payment_id, amount * 2 as twice from pay where customer = ? order by amount desc limit 2", [5]).collect()
    assert len(got) == 2 and got[0].twice > got[1].twice
    assert [tuple(r) for r in s.execute("show tables").collect()] == [("by_cur", "materialized_view"), ("pay", "source")]
    assert [tuple(r) for r in s.execute("describe pay").collect()][0] == ("payment_id", "varchar", "pri")
    s.execute("create index ix on pay(customer)")
    assert [r[0] for r in s.execute("show indexes on pay").collect()] == ["ix"]
    assert s.execute("select count(*) as n from sys.tables").first().n == 2
    s.execute("drop index ix on pay")
    s.execute("use other")
    assert s.execute("show tables").count() == 0
    assert {r[0] for r in s.execute("show schemas").collect()} == {"default", "other", "sys"}
    s.execute("use default")
    assert list(s.json_lines("select payment_id, amount, ts from pay where payment_id = 'payment000003'"))[1] == '["payment000003", "237.57", 1704067203000000]'
    assert [r.n for r in s.execute("select currency, count(*) as n from pay group by currency having count(*) > 29").collect()] == [30] * 4
    s.execute("drop materialized view by_cur")
    s.execute("drop source pay")
    assert s.execute("show tables").count() == 0


SINK = """create sink out with (brokername = "b", topicname = "o", headerencoding = "stringbytes", keyencoding = "{key}", valueencoding = "json",
  properties = (path = "{path}"), injectors = (meta("key").id, meta("header").c, a.b)) as select customer, currency, amount from pay where amount > 900"""


def test_a_sink_of_the_dialect_sends(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"), buckets=2)
    s.execute(SOURCE)
    s.execute(SINK.format(key="int64be", path=tmp_path / "t"))
    with pytest.raises(EngineError, match="say where"):
        s.execute(SINK.replace("properties = (path = \"{path}\"),", "").replace("sink out", "sink none").format(key="json"))
    s.execute("source set max rate pay 60")
    q = s.start("pay", s.messages("pay", "generator", {"name": "payments", "total": "120"}), str(tmp_path / "c"))
    s.execute("source set max rate pay 40")  # goes on at the new rate
    q = s.streams[("default", "pay")]
    q.processAllAvailable()
    q.stop()
    assert s.execute("select count(*) as n from pay").first().n == 120
    got = spark.read.parquet(f"{tmp_path}/t/o").collect()
    want = s.execute("select customer, currency, amount from pay where amount > 900").collect()
    assert sorted((int.from_bytes(r.key, "big"), r.headers["c"], bytes(r.value).decode()) for r in got) == sorted((r.customer, r.currency, f'{{"a":{{"b":{r.amount}}}}}') for r in want)
    assert Session(spark, str(tmp_path / "s"), buckets=2).engine.table("pay").options["max_rate"] == 40


def test_reset_ddl_stops_a_fill(spark, tmp_path):
    import threading
    import time

    s = Session(spark, str(tmp_path / "s"), buckets=2)
    s.execute(SOURCE)
    seen, plain = [], s.engine._fill

    def slow(t, q):
        plain(t, q)
        spark.range(40).repartition(40).selectExpr("java_method('java.lang.Thread', 'sleep', 5000L) as x").collect()

    s.engine._fill = slow

    def create():
        try:
            s.execute("create materialized view v as select customer from pay")
        except Exception as e:  # noqa: BLE001
            seen.append(e)

    t = threading.Thread(target=create)
    t.start()
    time.sleep(4)
    s.execute("reset ddl default")
    t.join(40)
    assert seen and not t.is_alive()
    assert [r[0] for r in s.execute("show tables").collect()] == ["pay"]


def test_shapes_that_are_no_select(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"))
    for sql in ("select a from sys.dummy union select x, x from sys.dummy", "select x from sys.dummy limit x", "select x from (select x from sys.dummy)", "select x from sys.dummy where x > any (select 1)", "select x from sys.dummy order x", "select x collate nope from sys.dummy", "select x from sys.dummy left sys.dummy"):
        with pytest.raises(Exception):  # noqa: B017
            s.execute(sql).collect()
    assert s.execute("select x, '{b}' as b from sys.dummy where x in (select x from sys.dummy) limit ? offset ?", [5, 0]).collect() == [(0, "{b}")]


def test_errors(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"))
    s.execute(SOURCE)
    s.execute("create materialized view v as select customer from pay")
    for sql, code in {
        "drop source pay": 1009, "select * from nope": 1002, "create source x(a bigint, primary key (a)) with (brokername = 'b')": 1005, "frobnicate": 1001, "create index i on pay(nope)": 1004, "drop index i on pay": 1006,
        SOURCE: 1003, SOURCE.replace("pay(", "p2(").replace("primary key (payment_id)", "primary key (nope)"): 1004, SOURCE.replace("pay(", "p2(").replace(', meta("timestamp")', ""): 1005, SOURCE.replace("pay(", "p2(").replace("customer bigint", "payment_id bigint"): 1001,
        "select a from pay where customer = ?": 1001, "create materialized view w as select customer from pay order by customer": 1008,
    }.items():
        with pytest.raises(EngineError) as e:
            s.execute(sql)
        assert e.value.code == code, (sql, str(e.value))


@pytest.mark.parametrize(("text", "anchor", "path"), [("a.b[0]['k']", "value", ["a", "b", 0, "k"]), ('meta("key").k0', "key", ["k0"]), ('meta("header").h', "header", ["h"]), ('meta("timestamp")', "timestamp", [])])
def test_selectors(text, anchor, path):
    got = parse_selector(text)
    assert (got.anchor, got.path) == (anchor, path)


@pytest.mark.parametrize("text", ['meta("nope").a', "a..b", "", 'meta("timestamp").x', "a[b]"])
def test_bad_selectors(text):
    with pytest.raises(EngineError):
        parse_selector(text)


def test_codecs(spark):
    from pyspark.sql import functions as F

    from tideline.sources.codecs import decode

    df = spark.sql("select X'FFFE' as a, X'00000007' as b, X'8000000000000000' as c, X'3FC00000' as f, cast('x' as binary) as s")
    got = df.select(decode(F.col("a"), "int16be"), decode(F.col("b"), "int32be"), decode(F.col("c"), "int64be"), decode(F.col("f"), "float32be"), decode(F.col("s"), "stringbytes"), decode(F.col("a"), "int32be")).first()
    assert tuple(got) == (-2, 7, -(2**63), 1.5, "x", None)
    with pytest.raises(EngineError):
        decode(F.col("a"), "csv")


def test_command_line(spark, tmp_path, capsys):
    from tideline.__main__ import main, statements

    assert [s.strip() for s in statements("select ';' as a; show tables ;")] == ["select ';' as a", "show tables", ""]
    assert main(["--folder", str(tmp_path / "s"), SOURCE + "; show tables; select * from nope"]) == 1
    out = capsys.readouterr()
    assert "pay" in out.out and "E1002" in out.err


def test_names_are_case_insensitive_and_aliases_show(spark, tmp_path):
    s = Session(spark, str(tmp_path / "s"))
    s.execute(SOURCE.replace("create source pay", "CREATE SOURCE Pay"))
    assert s.execute("SELECT Payment_ID AS x, amount + 1, count(*) FROM PAY GROUP BY payment_id, amount").columns == ["x", "amount + 1", "count(*)"]
    assert [r[0] for r in s.execute("DESCRIBE PAY").collect()][0] == "payment_id"
