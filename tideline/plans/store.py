"""Keyed tables in a shared folder: logs of row changes in hash buckets, merged on read.

A batch's changes are written once, dealt to the buckets of their keys, and these files are the table's newest layer: a
commit only adds their names to the manifest, so what a batch writes grows with the batch and not with the table. A read
takes each key's newest version from the layers of a bucket. A bucket's newest layers are merged as soon as together they
hold half as many bytes as the one below, so a bucket has a number of layers that grows with the logarithm of its size.

Manifests are numbered files, each written aside and then renamed; the highest number is in force. Nothing is ever
replaced or deleted before its successor is complete, so a crash at any point leaves a whole table.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CONFLICT, EngineError

#: Parts of a key before this character choose its bucket; JSON text never holds it as such.
PART = "\u0001"
#: Batches for which files that no manifest names stay, for queries that still read them.
KEPT = 8
#: Layers that a bucket has before a merge is considered.
LAYERS = 4


class Files:
    """Small text files and folders on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> bool:
        """Writes a new file whole; False if there is one of that name."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            return False
        return True

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[tuple[str, str]]:
        """(name, path) of what a folder holds; nothing if there is no such folder."""
        fs, p = self._at(path)
        return [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()


class Versions:
    """A text that changes, as numbered files in a folder; the highest number counts."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _numbers(self) -> list[tuple[int, str]]:
        return sorted((int(n[:-5]), p) for n, p in self.files.names(self.folder) if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> str | None:
        known = self._numbers()
        return self.files.read(known[-1][1]) if known else None

    def write(self, text: str) -> None:
        known = self._numbers()
        number = known[-1][0] + 1 if known else 1
        if not self.files.write(f"{self.folder}/{number:012d}.json", text):
            raise EngineError(CONFLICT, f"another engine writes to {self.folder}")
        for _, path in known[:-2]:
            self.files.remove(path)


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64(F.substring_index("k", PART, 1)), F.lit(buckets)).cast("int")


def dealt(df: DataFrame, path: str, buckets: int) -> None:
    """Writes rows with a key ``k`` into a folder for each bucket; the attempt that completes first counts."""
    # rebalanced: adaptive execution splits a large bucket over tasks and puts small ones together
    rows = df.withColumn("bucket", bucket_of(buckets)).hint("rebalance", F.col("bucket"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


class KeyedTable:
    """(k, row) with one row for each key."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # any column may be null
        self.files = Files(spark)
        self.versions = Versions(self.files, f"{self.folder}/_manifest")

    def manifest(self) -> dict:
        text = self.versions.read()
        return json.loads(text) if text else {"batch": -1, "layers": {}}

    # -- reading -------------------------------------------------------------------------------------------------------
    def _load(self, paths: list[str], *columns: str) -> DataFrame:
        known = {"k": T.StringType(), "prev": self.schema, "curr": self.schema, "v": T.LongType()}
        shape = T.StructType([T.StructField(c, known[c]) for c in columns])
        return self.spark.read.schema(shape).parquet(*paths).select(*columns) if paths else self.spark.createDataFrame([], shape)

    def _newest(self, paths: list[str]) -> DataFrame:
        """(k, curr) of each key's last version; a deleted key has a null curr."""
        last = self._load(paths, "k", "curr", "v").groupBy("k").agg(F.max_by(F.struct("curr"), "v").alias("_c"))
        return last.select("k", F.col("_c.curr").alias("curr"))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """(k, row), of all buckets or some."""
        layers = [x for b, x in self.manifest()["layers"].items() if buckets is None or int(b) in buckets]
        single = [x[0][0] for x in layers if len(x) == 1]
        many = [p for x in layers if len(x) > 1 for p, _ in x]
        out = self._load(single, "k", "curr")
        if many:
            out = out.unionByName(self._newest(many)) if single else self._newest(many)
        return out.where("curr is not null").select("k", F.col("curr").alias("row"))

    def rows(self) -> DataFrame:
        return self.read().select("row.*")

    # -- writing -------------------------------------------------------------------------------------------------------
    def has(self, batch: int) -> bool:
        return self.files.exists(f"{self.folder}/b{batch}/_SUCCESS")

    def log(self, changes: DataFrame, batch: int) -> DataFrame:
        """The batch's changes (k, prev, curr) as first computed: written, unless an attempt before did, and read back."""
        if not self.has(batch):
            shaped = [F.col(c).cast(self.schema).alias(c) for c in ("prev", "curr")]
            dealt(changes.select("k", *shaped, F.lit(batch).cast("bigint").alias("v")), f"{self.folder}/b{batch}", self.buckets)
        return self.logged(batch)

    def logged(self, batch: int) -> DataFrame:
        return self._load([f"{self.folder}/b{batch}"], "k", "prev", "curr")

    def commit(self, batch: int) -> None:
        """Puts the logged batch in force; committing again changes nothing."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return
        for name, path in self.files.names(f"{self.folder}/b{batch}"):
            if name.startswith("bucket="):
                manifest["layers"].setdefault(name[7:], []).append([path, self.files.size(path)])
        manifest["batch"] = batch
        self.versions.write(json.dumps(manifest))
        self._compact(manifest)
        self._sweep(manifest)

    def _compact(self, manifest: dict) -> None:
        """Merges the newest layers of buckets where they have grown beside the layers below."""
        due: dict[str, int] = {}
        for b, layers in manifest["layers"].items():
            start, above = len(layers) - 1, layers[-1][1]
            while start > 0 and layers[start - 1][1] <= 2 * above:
                start -= 1
                above += layers[start][1]
            if len(layers) > LAYERS and start < len(layers) - 1:
                due[b] = start
        if not due:
            return
        merged = self._newest([p for b, start in due.items() for p, _ in manifest["layers"][b][start:]])
        whole = [int(b) for b, start in due.items() if start == 0]  # nothing below: deleted keys can go
        merged = merged.where(F.col("curr").isNotNull() | ~bucket_of(self.buckets).isin(whole))
        path = f"{self.folder}/m{manifest['batch']}-{uuid.uuid4().hex[:8]}"
        dealt(merged.select("k", "curr", F.lit(manifest["batch"]).cast("bigint").alias("v")), path, self.buckets)
        fresh = {name[7:]: p for name, p in self.files.names(path) if name.startswith("bucket=")}
        for b, start in due.items():
            layers = manifest["layers"][b][:start] + ([[fresh[b], self.files.size(fresh[b])]] if b in fresh else [])
            manifest["layers"][b] = layers
            if not layers:
                del manifest["layers"][b]
        self.versions.write(json.dumps(manifest))

    def _sweep(self, manifest: dict) -> None:
        """Removes folders of old batches that no layer stands in."""
        used = {p.rsplit("/", 2)[-2] for layers in manifest["layers"].values() for p, _ in layers}
        for name, path in self.files.names(self.folder):
            number = name[1:].split("-")[0]
            if name[0] in "bm" and number.isdigit() and int(number) <= manifest["batch"] - KEPT and name not in used:
                self.files.remove(path)

    def drop(self) -> None:
        self.files.remove(self.folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder that is set.

    Only a local master, whose executors are the driver's own process, may go without and gets one of the machine's own.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError(CONFLICT, "set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/tideline-checkpoints"
    return folder.rstrip("/")
