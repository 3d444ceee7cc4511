"""Sources of messages (key, value, headers, timestamp, partition, offset) and their way into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..types import ColumnType, coerced
from .codecs import decode
from .selectors import parse_selector, select

MESSAGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
RATE_OPTIONS = {"kafka": "maxOffsetsPerTrigger", "files": "maxFilesPerTrigger", "generator": "rowspertrigger"}


def parsed(messages: DataFrame, columns: list[tuple[str, ColumnType, str]], key_encoding: str = "json", value_encoding: str = "json", descriptors: bytes | None = None) -> DataFrame:
    """Messages as rows. ``columns``: (name, type, selector). Adds ``_seq``, the arrival order."""
    opened = messages.select(decode(F.col("key"), key_encoding, descriptors).alias("_key"), decode(F.col("value"), value_encoding, descriptors).alias("_value"), "headers", "timestamp", F.struct("timestamp", "partition", "offset").alias("_seq"))
    out = []
    for name, kind, selector in columns:
        picked = select(parse_selector(selector), F.col("_key"), F.col("_value"), F.col("headers"), F.col("timestamp"))
        source = opened.select(picked.alias("x")).schema["x"].dataType
        if isinstance(source, T.StringType) and kind.name == "timestamp":  # text or epoch milliseconds
            number = F.timestamp_micros((picked.try_cast("decimal(38,6)") * 1000).cast("bigint"))
            picked, source = F.when(picked.rlike(r"^-?\d+(\.\d+)?$"), number).otherwise(picked.try_cast("timestamp")), T.TimestampType()
        elif isinstance(source, T.StringType) and kind.name in ("tinyint", "int", "bigint"):
            picked = F.when(picked == "true", "1").when(picked == "false", "0").otherwise(picked)
        out.append(coerced(picked, source, kind).alias(name))
    return opened.select(*out, "_seq")


def read_messages(spark: SparkSession, kind: str, options: dict[str, str], stream: bool = True) -> DataFrame:
    """``kind``: kafka (needs Spark's Kafka package), files (a folder of Parquet files of messages) or generator."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    if kind == "kafka":
        df = reader.option("includeHeaders", "true").format("kafka").load()
        return df.select("key", "value", F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))).alias("headers"), "timestamp", "partition", "offset")
    if kind == "files":
        return reader.schema(MESSAGE).format("parquet").load(options["path"])
    spark.dataSource.register(MessageGenerator)
    return reader.format("messages").load()


# -- generators --------------------------------------------------------------------------------------------------------
# Field names of the generated messages, kinds and currencies of payments.
def simple_message(offset: int) -> tuple[dict, dict, dict]:
    return {"primary_key_field": f"pk-{offset}"}, {"varchar_field": f"foo{offset}", "bigint_field": offset % 1000}, {}


PAYMENT_TYPES, CURRENCIES = ("btc", "p2p", "other"), ("gbp", "usd", "eur", "aud")


def payment_message(offset: int) -> tuple[dict, dict, dict]:
    value = {"customer_id": offset % 17, "amount": f"{(offset * 7919) % 100000 / 100:.2f}", "payment_type": PAYMENT_TYPES[offset % 3], "currency": CURRENCIES[offset % 4]}
    return {"payment_id": f"payment{offset:06d}"}, value, {"fraud_score": f"{(offset * 31) % 100 / 100:.2f}"}


GENERATORS = {"simple": simple_message, "payments": payment_message}


def _rows(name: str, start: int, end: int):
    import datetime
    import json

    make, zero = GENERATORS[name], datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    for i in range(start, end):
        key, value, headers = make(i)
        yield (json.dumps(key).encode(), json.dumps(value).encode(), headers, zero + datetime.timedelta(seconds=i), 0, i)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _BatchReader(DataSourceReader):
    def __init__(self, options):
        self.name, self.total, self.parts = options.get("name", "simple"), int(options.get("total", 1000)), int(options.get("partitions", 4))

    def partitions(self):
        step = -(-self.total // self.parts) or 1
        return [_Range(a, min(a + step, self.total)) for a in range(0, self.total, step)] or [_Range(0, 0)]

    def read(self, partition):
        yield from _rows(self.name, partition.start, partition.end)


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.name, self.total, self.rate = options.get("name", "simple"), int(options.get("total", 1000)), int(options.get("rowspertrigger", 100))

    def initialOffset(self):
        return {"offset": 0}

    def read(self, start):
        end = min(self.total, start["offset"] + self.rate)
        return iter(list(_rows(self.name, start["offset"], end))), {"offset": end}

    def readBetweenOffsets(self, start, end):
        return _rows(self.name, start["offset"], end["offset"])


class MessageGenerator(DataSource):
    """Made-up messages: options name (simple, payments), total, partitions, rowspertrigger."""

    @classmethod
    def name(cls):
        return "messages"

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return _BatchReader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)
