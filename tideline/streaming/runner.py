"""Continuous ingest: one streaming query per source, exactly once through batch ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..sources.codecs import encode
from ..sources.selectors import parse_selector


def start_source(engine: Engine, source: str, rows: DataFrame, checkpoint: str, seq: str = "_seq", once: bool = False):
    """Feeds a stream of rows (as ``parsed`` makes them) into a source; a restart goes on from ``checkpoint``."""
    writer = rows.writeStream.queryName(f"source_{source}").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, batch: engine.ingest(source, df, batch, [seq]))
    return (writer.trigger(availableNow=True) if once else writer).start()


def sink_messages(changes: DataFrame, injectors: list[tuple[str, str]], key_encoding: str = "json", value_encoding: str = "json", partitions: int = 8) -> DataFrame:
    """(key, value, headers, timestamp, partition) from a batch of changes; deletes have null values.

    ``injectors``: (column, selector) tells where a column goes: ``meta("key").a``, ``meta("header").h``,
    ``meta("timestamp")`` or a path in the value. Keys, headers and times of deletes are those of the row that goes.
    """
    places: dict[str, list[tuple[list, Column]]] = {"key": [], "value": [], "header": [], "timestamp": []}
    gone = F.col("curr").isNull()
    for column, text in injectors:
        selector = parse_selector(text, injecting=True)
        kept = F.col(f"curr.`{column}`")
        places[selector.anchor].append((selector.path, kept if selector.anchor == "value" else F.coalesce(kept, F.col(f"prev.`{column}`"))))
    key = encode(places["key"], key_encoding)
    headers = F.create_map(*[x for path, c in places["header"] for x in (F.lit(str(path[0])), c.cast("string"))]) if places["header"] else F.lit(None)
    at = places["timestamp"][0][1].cast("timestamp") if places["timestamp"] else F.current_timestamp()
    return changes.select(
        key.alias("key"),
        F.when(~gone, encode(places["value"], value_encoding)).alias("value"),
        headers.cast("map<string,string>").alias("headers"),
        at.alias("timestamp"),
        F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"),
    )


def folder_sink(path: str, **shape) -> Callable[[DataFrame, int], None]:
    """A writer for ``Engine.create_sink``: one folder for each batch, overwritten when a batch is sent again."""

    def write(changes: DataFrame, batch: int) -> None:
        sink_messages(changes, **shape).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def kafka_sink(topic: str, options: dict[str, str], **shape) -> Callable[[DataFrame, int], None]:
    """A writer to a topic; needs Spark's Kafka package. A batch sent again is there twice, as with any such writer."""

    def write(changes: DataFrame, batch: int) -> None:
        out = sink_messages(changes, **shape)
        headers = F.transform(F.map_entries("headers"), lambda h: F.struct(h["key"].alias("key"), h["value"].cast("binary").alias("value")))
        out = out.select("key", "value", headers.alias("headers"), F.lit(topic).alias("topic"))
        out.write.format("kafka").options(**options).option("includeHeaders", "true").save()

    return write


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "0 seconds", keys: list[str] = (), aggregates=()) -> DataFrame:
    """Extension: tumbling or sliding event-time windows with a watermark, for batch or stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    return marked.groupBy(window, *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], aggregates, late: str = "0 seconds") -> DataFrame:
    """Extension: session windows per key."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(F.col(time), gap), *keys).agg(*aggregates)
