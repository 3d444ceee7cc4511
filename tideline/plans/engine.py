"""Sources, materialized views and sinks kept up to date batch by batch.

A batch of a source becomes changes (k, prev, curr) against the source's table; these run through the views that read it,
in dependency order, as changes again. Each table commits once per batch.

Batches of all sources form one sequence. A batch is noted as pending before it writes anything, and its source's
changes, written whole, are the point from which it counts: a pending batch is finished from them before any other
batch starts, be it after an error, by another stream's thread or by an engine that opens the folder anew, and one that
never came so far is forgotten, to be taken again when its stream replays it. Every step writes its result once under
the batch's number, so finishing repeats nothing. One engine at a time owns a folder; a second one that writes to it
gets an error from the numbered manifests.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import HAS_CHILDREN, NULL_KEY, TABLE_EXISTS, UNKNOWN_TABLE, UNSUPPORTED, EngineError
from ..functions.dialect import kind_in
from ..types import common_type, name_of
from . import changelog as C
from .select import AGGREGATES, Query, Select, has_aggregate, parse_select, spark_text
from .store import PART, Files, KeyedTable, Versions, dealt


@dataclass
class Table:
    name: str
    kind: str  # source, materialized_view, sink
    schema: str  # Spark schema as JSON
    keys: list[str] = field(default_factory=list)
    query: str = ""
    parents: list[str] = field(default_factory=list)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Engine:
    """``folder``: in shared storage; holds the catalog, tables and the steps of a pending batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, zero_sum: bool = False, keep_empty: bool = False):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.zero_sum, self.keep_empty = zero_sum, keep_empty
        self.files = Files(spark)
        self.catalog = Versions(self.files, f"{self.folder}/catalog")
        text = self.catalog.read()
        saved = json.loads(text) if text else {"tables": [], "batch": 0, "streams": {}, "pending": None}
        self.tables = {t["name"]: Table(**t) for t in saved["tables"]}
        self.batch, self.streams, self.pending = saved["batch"], saved["streams"], saved["pending"]
        self.lock = threading.RLock()
        self._plans: dict[tuple, object] = {}
        self.sink_writers: dict[str, Callable[[DataFrame, int], None]] = {}

    def save(self) -> None:
        saved = {"tables": [vars(t) for t in self.tables.values()], "batch": self.batch, "streams": self.streams, "pending": self.pending}
        self.catalog.write(json.dumps(saved))

    # -- catalog -----------------------------------------------------------------------------------------------------
    def table(self, name: str) -> Table:
        t = self.tables.get(name.lower())
        if t is None:
            raise EngineError(UNKNOWN_TABLE, f"unknown table {name}")
        return t

    def children(self, name: str) -> list[str]:
        return [t.name for t in self.tables.values() if name in t.parents]

    def store(self, name: str, struct: T.StructType | None = None) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/tables/{name}", struct or self.table(name).struct(), self.buckets)

    def read(self, name: str) -> DataFrame:
        """The visible columns of a table's current rows."""
        t = self.table(name)
        if t.kind == "sink" or t.options.get("transient"):
            raise EngineError(UNSUPPORTED, f"{name} holds no rows")
        rows = self.store(t.name).rows()
        ttl = t.options.get("retention_s")
        return rows.where(f"row_time > current_timestamp() - make_dt_interval(0, 0, 0, {float(ttl)})") if ttl else rows

    def drop(self, name: str, kind: str | None = None) -> None:
        t = self.table(name)
        if kind and t.kind != kind:
            raise EngineError(UNKNOWN_TABLE, f"{name} is no {kind.replace('_', ' ')}")
        if below := self.children(t.name):
            raise EngineError(HAS_CHILDREN, f"{name} has children: {', '.join(sorted(below))}")
        del self.tables[t.name]
        self.sink_writers.pop(t.name, None)
        self.streams.pop(t.name, None)
        self.save()
        self._erase(t)

    def _erase(self, t: Table) -> None:
        self.files.remove(f"{self.folder}/tables/{t.name}")
        for i in range(len(parse_select(t.query).branches) if t.query else 0):
            for part in ("groups", "values"):
                self.files.remove(f"{self.folder}/tables/{t.name}__{part}{i}")

    def _new(self, name: str) -> None:
        if name in self.tables:
            raise EngineError(TABLE_EXISTS, f"{name} exists already")

    def create_source(self, name: str, schema: T.StructType, keys: list[str], **options) -> Table:
        name = name.lower()
        self._new(name)
        t = Table(name, "source", schema.json(), keys, options=options)
        return self._added(t, lambda: self._seed(t, options["initial_state"]) if options.get("initial_state") else None)

    def _added(self, t: Table, fill: Callable[[], None]) -> Table:
        """Adds a table with what it starts with, or nothing at all."""
        with self.lock:
            self.finish()
            self._erase(t)  # what a creation that failed may have left
            self.tables[t.name] = t
            try:
                fill()
            except BaseException:
                del self.tables[t.name]
                self._erase(t)
                raise
            finally:
                self._forget(self.batch)
            self.save()
        return t

    def _seed(self, t: Table, other: str) -> None:
        rows = self.read(other)
        if [f.dataType for f in rows.schema] != [f.dataType for f in t.struct()]:
            raise EngineError(UNSUPPORTED, f"initial state: {other} has other columns than {t.name}")
        named = rows.toDF(*t.struct().names)
        key = C.key_of(*t.keys) if t.keys else C.key_of(*t.struct().names)
        seeded = named.select(key.alias("k"), F.lit(None).cast(t.struct()).alias("prev"), F.struct(*t.struct().names).alias("curr"))
        batch, table = self._next(), self.store(t.name)
        table.log(seeded, batch)
        table.commit(batch)

    def _next(self) -> int:
        self.batch += 1
        return self.batch

    def create_view(self, name: str, query: str, initial_state: str | None = None) -> Table:
        name = name.lower()
        self._new(name)
        parsed = self._checked(parse_select(query))
        options = {"initial_state": initial_state} if initial_state else {}
        t = Table(name, "materialized_view", self._schema(parsed).json(), query=query, parents=sorted({b.table for b in parsed.branches}), options=options)

        def fill() -> None:
            if initial_state:
                self._seed(t, initial_state)
            self._fill(t, parsed)

        return self._added(t, fill)

    def create_sink(self, name: str, query: str, writer: Callable[[DataFrame, int], None] | None = None, **options) -> Table:
        """``writer(changes, batch)`` sends changes of at most one row for each key; sent again under the same batch, they
        replace what was sent. Options ``emit_after`` (seconds) and ``max_rows`` hold changes back: see ``_emit``."""
        name = name.lower()
        self._new(name)
        parsed = self._checked(parse_select(query))
        if any(self._aggregates(b) for b in parsed.branches):
            raise EngineError(UNSUPPORTED, "a sink's query can't aggregate")
        t = Table(name, "sink", self._schema(parsed).json(), query=query, parents=sorted({b.table for b in parsed.branches}), options=options)
        if writer:
            self.sink_writers[name] = writer
        return self._added(t, lambda: None)

    def columns(self, query: str) -> list[str]:
        """The names of a view's or sink's columns."""
        return self._schema(self._checked(parse_select(query))).names

    # -- compiling views ---------------------------------------------------------------------------------------------
    def _checked(self, q: Query) -> Query:
        for b in q.branches:
            if b.order or b.limit:
                raise EngineError(UNSUPPORTED, "a view can't order or limit its rows")
            if self.table(b.table).kind == "sink":
                raise EngineError(UNSUPPORTED, f"{b.table} is a sink")
        if len({len(self._items(b)) for b in q.branches}) > 1:
            raise EngineError(UNSUPPORTED, "the branches of a union have different numbers of columns")
        return q

    def _aggregates(self, b: Select) -> bool:
        return bool(b.group) or b.distinct or any(has_aggregate(i.text) for i in b.items)

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.table(table).struct())

    def _items(self, b: Select) -> list[tuple[list, str]]:
        out = []
        for i in b.items:
            if i.star:
                out += [([("name", f"`{c}`")], c) for c in self.table(b.table).struct().names]
            else:
                out.append((i.text, i.name))
        return out

    def _plain(self, b: Select) -> list[tuple[str, str]]:
        kind = kind_in(self._empty(b.table))
        return [(spark_text(t, kind), n) for t, n in self._items(b)]

    def _grouped(self, b: Select):
        """(groups, calls, items, having): calls are (function, argument, name); items and having refer to names."""
        kind = kind_in(self._empty(b.table))
        items = self._items(b)
        by_name = {n.lower(): t for t, n in items}
        if b.distinct:
            groups = [(spark_text(t, kind), f"_g{i}") for i, (t, _) in enumerate(items)]
            return groups, [], [(f"_g{i}", n) for i, (_, n) in enumerate(items)], None
        groups: list[tuple[str, str]] = []
        for i, g in enumerate(b.group):
            toks = g
            if len(g) == 1 and g[0][0] == "num":  # position in the select list
                toks = items[int(g[0][1]) - 1][0]
            elif len(g) == 1 and g[0][1].lower() in by_name and g[0][1].lower() not in self.table(b.table).struct().names:
                toks = by_name[g[0][1].lower()]
            groups.append((spark_text(toks, kind), f"_g{i}"))
        calls: list[tuple[str, str, str]] = []

        def named(f: str, argument: str) -> str:
            for call in calls:
                if call[:2] == (f, argument):
                    return call[2]
            calls.append((f, argument, f"_a{len(calls)}"))
            return calls[-1][2]

        def value(f: str, argument: str) -> str:
            if f != "avg" or argument.startswith("distinct "):
                return named(f, argument)
            result = self._empty(b.table).selectExpr(f"avg({argument}) as x").schema[0].dataType.simpleString()
            total = named("sum", argument)
            exact = f"cast({total} as double)" if result == "double" else total
            return f"cast(try_divide({exact}, {named('count', argument)}) as {result})"

        def over_groups(toks, aliases: bool = False) -> str:
            text = spark_text([t for x in toks for t in (by_name[x[1].lower()] if aliases and x[0] == "name" and x[1].lower() in by_name and x[1].lower() not in self.table(b.table).struct().names else [x])], None)
            out, at = "", 0
            while m := re.compile(rf"\b({'|'.join(AGGREGATES)})\(", re.I).search(text, at):
                depth, end = 1, m.end()
                while depth:
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                    end += 1
                out += _outside(text[at : m.start()], groups) + value(m[1].lower(), text[m.end() : end - 1])
                at = end
            return out + _outside(text[at:], groups)

        over = [(over_groups(t), n) for t, n in items]
        return groups, calls, over, over_groups(b.having, True) if b.having else None

    def _schema(self, q: Query) -> T.StructType:
        shapes = [self._batch(b, self._empty(b.table)).schema for b in q.branches]
        out = shapes[0]
        for s in shapes[1:]:
            out = T.StructType([T.StructField(a.name, common_type(a.dataType, b.dataType)) for a, b in zip(out, s, strict=True)])
        for f in out:
            name_of(f.dataType)  # raises for a type that no column has
        return T.StructType([T.StructField(f.name, f.dataType) for f in out])

    def _batch(self, b: Select, rows: DataFrame) -> DataFrame:
        """The branch's query over given rows, all at once."""
        if b.where:
            rows = rows.where(F.expr(spark_text(b.where, kind_in(rows))))
        if not self._aggregates(b):
            return rows.select(*[F.expr(e).alias(n) for e, n in self._plain(b)])
        groups, calls, items, having = self._grouped(b)
        keyed = rows.select("*", *[F.expr(e).alias(n) for e, n in groups])
        names = [n for _, n in groups]
        out = keyed.groupBy(*names).agg(*[F.expr(f"{f}({a})").alias(n) for f, a, n in calls] or [F.count(F.lit(1)).alias("_rows")])
        if having:
            out = out.where(F.expr(having))
        return out.select(*[F.expr(e).alias(n) for e, n in items])

    def _compiled(self, what: str, b: Select, build):
        """Compiled once for each branch; the tables under a view can't change while it is there."""
        key = (what, repr(b), self.table(b.table).schema)
        if key not in self._plans:
            self._plans[key] = build(b)
        return self._plans[key]

    # -- incremental -------------------------------------------------------------------------------------------------
    def _through(self, t: Table, index: int, b: Select, changes: DataFrame, batch: int) -> DataFrame:
        """Changes of a view's branch from those of its parent."""
        if b.where:
            changes = C.filtered(changes, self._compiled("where", b, lambda b: spark_text(b.where, kind_in(self._empty(b.table)))))
        if self._aggregates(b):
            changes = self._group_changes(t, index, b, changes, batch)
        else:
            changes = C.projected(changes, self._compiled("plain", b, self._plain))
        shape = t.struct()
        for side in ("prev", "curr"):
            changes = changes.withColumn(side, F.when(F.col(side).isNotNull(), F.struct(*[F.col(f"{side}.`{f}`").cast(s.dataType).alias(s.name) for f, s in zip(changes.schema[side].dataType.names, shape, strict=True)])))
        return C.branch(changes, index) if len(parse_select(t.query).branches) > 1 else changes

    def _group_changes(self, t: Table, index: int, b: Select, changes: DataFrame, batch: int) -> DataFrame:
        """Groups' changes from a batch's rows; only buckets of touched groups are read.

        Sums and counts add what the batch brings. For other aggregates each group's argument values are kept with how
        often they occur, so that a value which goes is known to be the last of its kind; these groups are then
        aggregated from their values, the parent's rows are not read again.
        """
        groups, calls, items, having = self._compiled("grouped", b, self._grouped)
        names = [n for _, n in groups]
        invertible = all(f in ("sum", "count") and not a.startswith("distinct ") for f, a, _ in calls)
        if invertible:
            added = C.deltas(changes, groups, calls)
            shape = T.StructType([T.StructField(f, added.schema[f].dataType) for f in added.columns if f != "k"])
            state = self.store(f"{t.name}__groups{index}", shape)
            if not state.has(batch):
                added, touched = self._staged(added, f"{t.name}__deltas{index}", batch)
                moved = C.merged(state.read(touched), added, names, calls, self.keep_empty)
        else:
            given: dict[str, str] = {}
            for _, a, _ in calls:
                if a != "*":
                    given.setdefault(a, f"_x{len(given)}")
            arguments = [(a.removeprefix("distinct "), x) for a, x in given.items()]
            added = C.value_deltas(changes, groups, arguments)
            fields = [*names, *given.values(), "_rows"]
            values = self.store(f"{t.name}__values{index}", T.StructType([T.StructField(f, added.schema[f].dataType) for f in fields]))
            fresh = C.of_values(values.read(), names, calls, given)
            state = self.store(f"{t.name}__groups{index}", fresh.schema["curr"].dataType)
            if not state.has(batch):
                added, touched = self._staged(added, f"{t.name}__deltas{index}", batch)
                if not values.has(batch):
                    values.log(C.merged(values.read(touched), added, fields[:-1], []), batch)
                values.commit(batch)
                keys = added.select(F.substring_index("k", PART, 1).alias("k")).distinct()
                of = values.read(touched).withColumn("_g", F.substring_index("k", PART, 1))
                of = of.join(keys.withColumnRenamed("k", "_g"), "_g", "left_semi").drop("_g")
                moved = keys.join(C.of_values(of, names, calls, given), "k", "left")
                moved = C.against(moved, state.read(touched))
        if not state.has(batch):
            state.log(moved, batch)
        moved = state.logged(batch)
        state.commit(batch)
        if having:
            moved = C.filtered(moved, self._sums(having, calls, invertible))
        return C.projected(moved, [(self._sums(e, calls, invertible), n) for e, n in items])

    def _sums(self, text: str, calls, invertible: bool) -> str:
        """References to sums, which are NULL (or, with ``zero_sum``, 0) where nothing was added."""
        if invertible:
            for f, _, n in calls:
                if f == "sum" and not self.zero_sum:
                    text = re.sub(rf"\b{n}\b", f"if({n}_n = 0, null, {n})", text)
        return text

    def _staged(self, df: DataFrame, name: str, batch: int) -> tuple[DataFrame, list[int]]:
        """A step of the batch, written once, and the buckets of its keys."""
        path = f"{self.folder}/changes/b{batch}/{name}"
        if not self.files.exists(f"{path}/_SUCCESS"):
            dealt(df, path, self.buckets)
        touched = [int(n[7:]) for n, _ in self.files.names(path) if n.startswith("bucket=")]
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns), touched

    def _fill(self, t: Table, q: Query) -> None:
        batch, out = self._next(), None
        for i, b in enumerate(q.branches):
            parent = self.table(b.table)
            if parent.options.get("transient") or not self.store(parent.name).manifest()["layers"]:
                continue
            rows = self.store(parent.name).read()
            changes = rows.select("k", F.lit(None).cast(parent.struct()).alias("prev"), F.col("row").alias("curr"))
            part = self._through(t, i, b, changes, batch)
            out = part if out is None else out.unionByName(part)
        if out is not None:
            table = self.store(t.name)
            table.log(out, batch)
            table.commit(batch)

    def ingest(self, source: str, batch_df: DataFrame, stream_batch: int | None = None, seq: list[str] | None = None, deleted: str | None = None) -> None:
        """One batch of a source's rows. ``seq``: columns that order arrivals; ``stream_batch``: id for exactly-once."""
        with self.lock:
            self.finish()
            t = self.table(source)
            if t.kind != "source":
                raise EngineError(UNSUPPORTED, f"{source} is no source")
            if stream_batch is not None and stream_batch <= self.streams.get(t.name, -1):
                return
            batch = self._next()
            self.pending = {"source": t.name, "id": stream_batch, "batch": batch}
            self.save()
            self._changes(t, batch_df, batch, seq, deleted)
            self.finish()

    def finish(self) -> None:
        """Completes the batch that is pending, or forgets it if its source's changes are not written whole."""
        with self.lock:
            if not (pending := self.pending):
                return
            batch, t = pending["batch"], self.tables.get(pending["source"])
            if t and self.store(t.name).has(batch):
                changes = self.store(t.name).logged(batch)
                if not t.options.get("transient"):
                    self.store(t.name).commit(batch)
                self._propagate({t.name: changes}, batch)
                if pending["id"] is not None:
                    self.streams[t.name] = pending["id"]
                if t.options.get("transient"):  # only the last batch's changes are there
                    for name, path in self.files.names(f"{self.folder}/tables/{t.name}"):
                        if name[0] == "b" and name != f"b{batch}":
                            self.files.remove(path)
            self.pending = None
            self.save()
            self._forget(batch)

    def _changes(self, t: Table, rows: DataFrame, batch: int, seq: list[str] | None, deleted: str | None) -> None:
        """Writes the batch's changes of its source."""
        if predicate := t.options.get("ingest_filter"):
            rows = rows.where(F.expr(spark_text(_tokens(predicate), kind_in(rows))))
        for k in t.keys:
            null = F.raise_error(F.lit(f"E{NULL_KEY} - null in key column {k}")).cast(rows.schema[k].dataType)
            rows = rows.withColumn(k, F.when(F.col(k).isNull(), null).otherwise(F.col(k)))
        if not seq:
            rows, seq = rows.withColumn("_arrival", F.monotonically_increasing_id()), ["_arrival"]
        rows = C.latest(rows, t.keys, seq, t.struct().names, deleted)
        row = F.struct(*[F.col(f"curr.`{f.name}`").cast(f.dataType).alias(f.name) for f in t.struct()])
        rows = rows.select("k", F.when(F.col("curr").isNotNull(), row).alias("curr"))
        table = self.store(t.name)
        if t.options.get("transient"):
            table.log(rows.select("k", F.lit(None).cast(t.struct()).alias("prev"), "curr").where("curr is not null"), batch)
            return
        rows, touched = self._staged(rows, f"{t.name}__batch", batch)
        table.log(C.against(rows, table.read(touched)), batch)

    def _propagate(self, changed: dict[str, DataFrame], batch: int) -> None:
        for t in self._order():
            branches, table = parse_select(t.query).branches, self.store(t.name)
            if not any(b.table in changed for b in branches):
                continue
            if not table.has(batch):
                out = None
                for i, b in enumerate(branches):
                    if b.table in changed:
                        part = self._through(t, i, b, changed[b.table], batch)
                        out = part if out is None else out.unionByName(part)
                table.log(out, batch)
            if t.kind == "sink":
                self._emit(t, batch)
            else:
                table.commit(batch)
                changed[t.name] = table.logged(batch)

    # -- sinks ---------------------------------------------------------------------------------------------------------
    def _held(self, t: Table) -> tuple[Versions, dict]:
        versions = Versions(self.files, f"{self.folder}/tables/{t.name}/_held")
        return versions, json.loads(versions.read() or '{"batches": [], "rows": 0, "since": 0, "last": -1}')

    def _emit(self, t: Table, batch: int | None, now: bool = False) -> None:
        """Sends a sink's changes, of several batches the last of each key.

        Changes are held back until ``max_rows`` of them wait or the first has waited ``emit_after`` seconds; without
        either each batch is sent at once. What is held back stands in the folder, so a restart goes on with it.
        """
        versions, held = self._held(t)
        if batch is not None and batch > held["last"]:
            wait = t.options.get("emit_after") or t.options.get("max_rows")
            rows = self.store(t.name).logged(batch).count() if wait else 0
            held = {"batches": [*held["batches"], batch], "rows": held["rows"] + rows, "since": held["since"] or time.time(), "last": batch}
        after, most = t.options.get("emit_after"), t.options.get("max_rows")
        due = now or not (after or most) or (after and time.time() - held["since"] >= after) or (most and held["rows"] >= most)
        if due and held["batches"]:
            table = self.store(t.name)
            out = None
            for b in held["batches"]:
                part = table.logged(b).withColumn("_batch", F.lit(b))
                out = part if out is None else out.unionByName(part)
            if len(held["batches"]) > 1:
                first, last = F.min_by(F.struct("prev"), "_batch"), F.max_by(F.struct("curr"), "_batch")
                out = out.groupBy("k").agg(first.alias("p"), last.alias("c")).select("k", F.col("p.prev").alias("prev"), F.col("c.curr").alias("curr"))
                out = out.where("prev is not null or curr is not null")
            if writer := self.sink_writers.get(t.name):
                writer(out.select("k", "prev", "curr"), held["batches"][-1])
            for b in [*held["batches"][:-1], held.get("sent", -1)]:
                self.files.remove(f"{self.folder}/tables/{t.name}/b{b}")
            held = {"batches": [], "rows": 0, "since": 0, "last": held["last"], "sent": held["batches"][-1]}
        versions.write(json.dumps(held))

    def emit_due(self, now: bool = False) -> None:
        """Sends what sinks hold back and is due by the clock (``now``: all of it); to be called from a timer."""
        with self.lock:
            self.finish()
            for t in [t for t in self.tables.values() if t.kind == "sink"]:
                self._emit(t, None, now)

    def _order(self) -> list[Table]:
        """Views and sinks, parents first."""
        done, out = {t.name for t in self.tables.values() if t.kind == "source"}, []
        left = [t for t in self.tables.values() if t.kind != "source"]
        while left:
            ready = [t for t in left if set(t.parents) <= done]
            out += ready
            done |= {t.name for t in ready}
            left = [t for t in left if t not in ready]
        return out

    def _forget(self, batch: int) -> None:
        """The steps of a batch go when all tables have taken it."""
        self.files.remove(f"{self.folder}/changes/b{batch}")

    # -- retention -----------------------------------------------------------------------------------------------------
    def reap(self, source: str) -> None:
        """Deletes rows past a source's retention time; views keep what they have of them."""
        t = self.table(source)
        if ttl := t.options.get("retention_s"):
            with self.lock:
                self.finish()
                batch, table = self._next(), self.store(t.name)
                old = table.read().where(f"row.row_time <= current_timestamp() - make_dt_interval(0, 0, 0, {float(ttl)})")
                table.log(old.select("k", F.col("row").alias("prev"), F.lit(None).cast(t.struct()).alias("curr")), batch)
                table.commit(batch)
                self.save()


def _tokens(text: str):
    from ..functions.dialect import tokens

    return tokens(text)


def _outside(text: str, groups: list[tuple[str, str]]) -> str:
    """Group expressions in a text become their columns."""
    for e, n in sorted(groups, key=lambda g: -len(g[0])):
        text = re.sub(rf"(?<![\w.`]){re.escape(e)}(?![\w`])", n, text)
    return text
