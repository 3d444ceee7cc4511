import datetime

from pyspark.sql import functions as F

from tideline.streaming.runner import sessions, windowed


def events(spark, folder):
    zero = datetime.datetime(2024, 1, 1)
    rows = [(i, zero + datetime.timedelta(minutes=m)) for i, m in enumerate([0, 1, 4, 11, 12, 40, 3, 41])]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp")
    for i in range(0, 8, 2):  # one file for each batch, in order of arrival
        df.where(F.col("id").between(i, i + 1)).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return df


def run(spark, stream, name, checkpoint):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_close_behind_the_watermark(spark, tmp_path):
    df = events(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    closed = run(spark, windowed(stream, "ts", "10 minutes", late="10 minutes", aggregates=[F.count(F.lit(1)).alias("n")]), "w", str(tmp_path / "c"))
    got = {r.window.start.minute: r.n for r in closed.collect()}
    assert got[10] == 2 and got[0] in (3, 4)  # the row that comes too late may still meet an open window
    batch = windowed(df, "ts", "10 minutes", aggregates=[F.count(F.lit(1)).alias("n")])
    assert {r.window.start.minute: r.n for r in batch.collect()} == {0: 4, 10: 2, 40: 2}


def test_sessions(spark, tmp_path):
    df = events(spark, str(tmp_path / "in")).withColumn("k", F.lit("a"))
    got = sorted(r.n for r in sessions(df, "ts", "6 minutes", ["k"], [F.count(F.lit(1)).alias("n")]).collect())
    assert got == [2, 2, 4]


def test_generator_and_integer_messages(spark):
    from tideline.sources.messages import parsed, read_messages
    from tideline.types import ColumnType

    messages = read_messages(spark, "generator", {"name": "simple", "total": "1200"}, stream=False)
    rows = parsed(messages, [("pk", ColumnType.parse("varchar"), 'meta("key").primary_key_field'), ("v", ColumnType.parse("bigint"), "bigint_field"), ("t", ColumnType.parse("timestamp(0)"), 'meta("timestamp")')])
    assert rows.count() == 1200
    assert rows.where("pk = 'pk-1100'").first().v == 100


def test_message_coercions(spark):
    from tideline.sources.messages import MESSAGE, parsed
    from tideline.types import ColumnType

    zero = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(b"{}", b'{"b": true, "ms": 1577836800123, "s": "2020-01-01 00:00:00.5", "d": "1.25", "n": null}', {}, zero, 0, 1)], MESSAGE)
    columns = [("b", "int", "b"), ("ms", "timestamp(3)", "ms"), ("s", "timestamp(0)", "s"), ("d", "decimal(5, 2)", "d"), ("n", "bigint", "n"), ("x", "varchar", "a.b[3]")]
    got = parsed(df, [(n, ColumnType.parse(t), s) for n, t, s in columns]).first()
    assert (got.b, got.ms.microsecond, got.s.second, str(got.d), got.n, got.x) == (1, 123000, 1, "1.25", None, None)
