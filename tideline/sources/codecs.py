"""Message decoding: bytes of a key, value or header to a column.

``json`` (selectors pick paths out of the text), ``stringbytes``, ``int16be/int32be/int64be``, ``float32be/float64be``,
``protobuf:<message>`` (needs descriptors and the ``protobuf`` package). Integers decode inside the JVM; floats and
protobuf have no built-in decoder and run as Arrow-batched functions. Sinks encode ``json``, ``stringbytes`` and integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BAD_PROPERTY, EngineError

INTEGERS = {"int16be": 2, "int32be": 4, "int64be": 8}
FLOATS = {"float32be": ">f4", "float64be": ">f8"}
NAMES = ("json", "stringbytes", *INTEGERS, *FLOATS)


def decode_integer(raw: Column, size: int) -> Column:
    """A big-endian two's complement number; other lengths give NULL."""
    unsigned = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    limit = 1 << (8 * size)
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    value = F.when(unsigned >= number(limit // 2), unsigned - number(limit)).otherwise(unsigned)
    return F.when(F.octet_length(raw) == size, value.cast("bigint"))


def decode_float(raw: Column, form: str) -> Column:
    kind = np.dtype(form)

    @F.pandas_udf("double")
    def unpack(column: pd.Series) -> pd.Series:
        whole = np.array([b is not None and len(b) == kind.itemsize for b in column], dtype=bool)
        out = pd.Series([None] * len(column), dtype="Float64")
        out[whole] = np.frombuffer(b"".join(column[whole]), dtype=kind).astype(np.float64)
        return out

    return unpack(raw)


def decode_protobuf(raw: Column, message: str, descriptors: bytes) -> Column:
    """The message as JSON text, for selectors. ``descriptors``: a serialised file descriptor set."""

    @F.pandas_udf("string")
    def to_json(column: pd.Series) -> pd.Series:
        from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory

        files = descriptor_pb2.FileDescriptorSet.FromString(descriptors)
        pool = descriptor_pool.DescriptorPool()
        for f in files.file:
            pool.Add(f)
        cls = message_factory.GetMessageClass(pool.FindMessageTypeByName(message))
        return column.map(lambda b: json_format.MessageToJson(cls.FromString(bytes(b)), preserving_proto_field_name=True) if b is not None else None)

    return to_json(raw)


def decode(raw: Column, encoding: str, descriptors: bytes | None = None) -> Column:
    """JSON, protobuf and text decode to text, numbers to numbers."""
    name = encoding.lower()
    if name in ("json", "stringbytes"):
        return raw.cast("string")
    if name in INTEGERS:
        return decode_integer(raw, INTEGERS[name])
    if name in FLOATS:
        return decode_float(raw, FLOATS[name])
    if name.startswith("protobuf:"):
        if descriptors is None:
            raise EngineError(BAD_PROPERTY, f"no descriptors registered for {encoding}")
        return decode_protobuf(raw, encoding.split(":", 1)[1], descriptors)
    raise EngineError(BAD_PROPERTY, f"unknown encoding {encoding!r}")


def encode(placed: list[tuple[list[str], Column]], encoding: str) -> Column:
    """Bytes of a sink's key or value from (path, column) pairs: one JSON object, or a single column's text or number."""
    name = encoding.lower()
    if name == "json":
        return F.to_json(_nested(placed), {"ignoreNullFields": "false"}).cast("binary")
    if len(placed) != 1:
        raise EngineError(BAD_PROPERTY, f"{encoding} takes one column, not {len(placed)}")
    column = placed[0][1]
    if name == "stringbytes":
        return column.cast("string").cast("binary")
    if name in INTEGERS:
        return F.unhex(F.right(F.lpad(F.hex(column.cast("bigint")), F.lit(16), F.when(column < 0, "F").otherwise("0")), F.lit(2 * INTEGERS[name])))
    raise EngineError(BAD_PROPERTY, f"a sink can't encode {encoding}")


def _nested(placed: list[tuple[list[str], Column]]) -> Column:
    heads: dict[str, list[tuple[list[str], Column]]] = {}
    for path, column in placed:
        heads.setdefault(path[0] if path else "value", []).append((path[1:], column))
    fields = []
    for head, below in heads.items():
        if len(below) > 1 and not all(path for path, _ in below):
            raise EngineError(BAD_PROPERTY, f"two columns are put at {head}")
        fields.append((below[0][1] if not below[0][0] else _nested(below)).alias(head))
    return F.struct(*fields) if fields else F.named_struct()
