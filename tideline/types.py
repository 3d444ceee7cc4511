"""The seven column types, their limits and their Spark counterparts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import OUT_OF_RANGE, PARSE, EngineError

RANGES = {"tinyint": (-128, 127), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
MAX_VARCHAR_BYTES = 65535
_TYPE = re.compile(r"^\s*(tinyint|int|bigint|double|varchar|timestamp|decimal)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$", re.I)


class ColumnType:
    """A declared type: name, and precision and scale or fractional digits where it has them."""

    def __init__(self, name: str, a: int | None = None, b: int | None = None):
        self.name, self.a, self.b = name, a, b

    @classmethod
    def parse(cls, text: str) -> ColumnType:
        m = _TYPE.match(text)
        if not m:
            raise EngineError(PARSE, f"unknown type {text!r}")
        name, a, b = m[1].lower(), m[2] and int(m[2]), m[3] and int(m[3])
        if name == "decimal":
            a, b = (10 if a is None else a), b or 0
            if not 1 <= a <= 38 or not 0 <= b <= min(30, a):
                raise EngineError(PARSE, f"decimal({a}, {b}): precision from 1 to 38, scale from 0 to 30 and not above the precision")
        elif name == "timestamp":
            a = a or 0
            if a > 6:
                raise EngineError(PARSE, f"timestamp({a}): at most 6 fractional digits")
        elif a is not None:
            raise EngineError(PARSE, f"{name} takes no arguments")
        return cls(name, a, b)

    def spark(self) -> T.DataType:
        return {"tinyint": T.ByteType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "varchar": T.StringType(), "timestamp": T.TimestampType(), "decimal": T.DecimalType(self.a or 10, self.b or 0)}[self.name]

    def __str__(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.a}, {self.b})"
        return f"timestamp({self.a})" if self.name == "timestamp" and self.a else self.name


def name_of(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision}, {kind.scale})"
    names = {T.ByteType: "tinyint", T.ShortType: "int", T.IntegerType: "int", T.LongType: "bigint", T.FloatType: "double", T.DoubleType: "double", T.StringType: "varchar", T.TimestampType: "timestamp(6)", T.TimestampNTZType: "timestamp(6)", T.BooleanType: "tinyint"}
    if type(kind) not in names:
        raise EngineError(PARSE, f"no column can have the type {kind.simpleString()}")
    return names[type(kind)]


def rounded(ts: Column, digits: int) -> Column:
    """A timestamp rounded half up to so many fractional digits."""
    if digits >= 6:
        return ts
    step = 10 ** (6 - digits)
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros + step // 2 - F.pmod(micros + step // 2, F.lit(step)))


def coerced(value: Column, source: T.DataType, target: ColumnType) -> Column:
    """A message's value as a column of the declared type; malformed text and values out of range raise an error.

    Numbers become timestamps as epoch milliseconds, booleans become 1 and 0.
    """
    name = target.name
    if isinstance(source, T.BooleanType):
        value, source = value.cast("int"), T.IntegerType()
    numeric = isinstance(source, T.NumericType)
    if name in RANGES:
        low, high = RANGES[name]
        wide = value.cast("decimal(38,0)") if not isinstance(source, T.FractionalType) else value.cast("double").cast("decimal(38,0)")
        bad = F.raise_error(F.concat(F.lit(f"E{OUT_OF_RANGE} - value out of range for {name}: "), value.cast("string")))
        return F.when(wide.between(low, high), wide.cast(target.spark())).when(wide.isNotNull(), bad.cast(target.spark()))
    if name == "varchar":
        text = value.cast("string")
        bad = F.raise_error(F.lit(f"E{OUT_OF_RANGE} - varchar longer than {MAX_VARCHAR_BYTES} bytes"))
        return F.when(F.octet_length(text) > MAX_VARCHAR_BYTES, bad.cast("string")).otherwise(text)
    if name == "timestamp":
        ts = F.timestamp_micros((value.cast("decimal(38,6)") * 1000).cast("bigint")) if numeric else value.cast("timestamp")
        return rounded(ts, target.a or 0)
    return value.cast(target.spark())


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a UNION ALL column: text beats all, a timestamp beside a number becomes text, numbers widen."""
    if a == b:
        return a
    stamps = (T.TimestampType, T.TimestampNTZType)
    if isinstance(a, T.StringType) or isinstance(b, T.StringType) or isinstance(a, stamps) != isinstance(b, stamps):
        return T.StringType()
    if isinstance(a, stamps):
        return T.TimestampType()
    if isinstance(a, (T.DoubleType, T.FloatType)) or isinstance(b, (T.DoubleType, T.FloatType)):
        return T.DoubleType()
    digits = {T.BooleanType: (1, 0), T.ByteType: (3, 0), T.ShortType: (5, 0), T.IntegerType: (10, 0), T.LongType: (20, 0)}
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        (p, s), (q, r) = ((x.precision, x.scale) if isinstance(x, T.DecimalType) else digits[type(x)] for x in (a, b))
        scale = max(s, r)
        return T.DecimalType(min(38, max(p - s, q - r) + scale), scale)
    order = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    return max((a, b), key=lambda x: order.index(type(x)))
