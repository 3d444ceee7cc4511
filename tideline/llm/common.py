"""Shared helpers: table access, shared-folder tables, Arrow column access."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder that is set already.

    Only a local master, whose executors are the driver's own process, may go without: it gets one of the machine's own.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tideline-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Tables that ``stored`` wrote and that are still there, in order.
_written: list[DataFrame] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _written.append(out)
    return out


def stored_in_buckets(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """As ``stored``, dealt by ``column`` without a shuffle: joins and groups by it read the table where it lies."""
    spark = df.sparkSession
    table = f"tideline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, column).saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.stored_as = path, table
    _written.append(out)
    return out


def stored_whole(make, name: str) -> DataFrame:
    """The table that ``make()`` describes, stored; tables stored on the way there are removed, as nothing reads them any more."""
    before = len(_written)
    out = stored(make(), name)
    discard(*_written[before:-1])
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote and that no later result reads."""
    for t in tables:
        if hasattr(t, "stored_as"):
            t.sparkSession.sql(f"drop table if exists {t.stored_as}")
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    gone = {t.stored_at for t in tables}
    _written[:] = [t for t in _written if t.stored_at not in gone]


def bare(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: extra input columns with clashing names never reach an operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1].copy()
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def batches_of(off: np.ndarray, most: int = 1 << 21):
    """Row ranges whose texts hold about ``most`` bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
