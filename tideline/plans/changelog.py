"""Changelog algebra: tables of (k, prev, curr) and the operators that carry row changes through a plan.

``k`` is the row's identity as text, ``prev`` and ``curr`` are structs of its visible columns: an insert has no prev, a
delete no curr. Every operator is a DataFrame transformation, so a batch of changes of any size stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import PART

#: Aggregates that repeated values don't change.
ONCE = ("min", "max", "bit_and", "bit_or", "approx_count_distinct")


#: How times stand in keys: to the microsecond, whatever the session's time zone.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def key_of(*columns: str) -> Column:
    """Row identity from key columns; nulls count as a value."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false", **_TIMES}) if columns else F.lit("{}")


def latest(batch: DataFrame, keys: list[str], seq: list[str], visible: list[str], deleted: str | None = None) -> DataFrame:
    """(k, curr) of a batch: of each key the row that arrived last (by ``seq``); a tombstone has a null curr."""
    row = F.struct(*[F.col(c) for c in visible])
    curr = F.when(~F.coalesce(F.col(deleted), F.lit(False)), row) if deleted else row
    rows = batch.select(key_of(*keys).alias("k"), F.struct(*[F.col(c) for c in seq]).alias("_s"), F.struct(curr.alias("curr")).alias("_c"))
    return rows.groupBy("k").agg(F.max_by("_c", "_s").alias("_c")).select("k", F.col("_c.curr").alias("curr"))


def against(batch: DataFrame, state: DataFrame) -> DataFrame:
    """(k, prev, curr) from ``batch(k, curr)`` and the stored ``state(k, row)``; deletes of absent rows drop out."""
    joined = batch.join(state.select("k", F.col("row").alias("prev")), "k", "left").select("k", "prev", "curr")
    return joined.where("prev is not null or curr is not null")


def filtered(changes: DataFrame, predicate: str) -> DataFrame:
    """Rows that pass on either side: both sides a change, one side an insert or a delete. NULL doesn't pass."""
    flags = changes
    for side in ("prev", "curr"):
        flags = _on_side(flags, side, lambda s: F.when(F.coalesce(F.expr(predicate), F.lit(False)), F.col(s)))
    return flags.where("prev is not null or curr is not null")


def _on_side(changes: DataFrame, side: str, build) -> DataFrame:
    """Replaces a side by an expression over the side's own columns."""
    names = changes.schema[side].dataType.fieldNames()
    other = "curr" if side == "prev" else "prev"
    opened = changes.select("k", F.col(side).alias("_side"), F.col(other).alias("_other"), *[F.col(f"{side}.`{n}`").alias(n) for n in names])
    out = opened.select("k", build("_side").alias(side), F.col("_other").alias(other))
    return out.select("k", "prev", "curr")


def projected(changes: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """Both sides through (expression, name) items; the key stays, so a projection may drop key columns."""
    for side in ("prev", "curr"):
        changes = _on_side(changes, side, lambda s: F.when(F.col(s).isNotNull(), F.struct(*[F.expr(e).alias(n) for e, n in items])))
    return changes


def branch(changes: DataFrame, index: int) -> DataFrame:
    """A UNION ALL branch: rows of different branches never share a key."""
    return changes.select(F.concat(F.lit(f"{index}:"), "k").alias("k"), "prev", "curr")


def signed(changes: DataFrame) -> DataFrame:
    """Flat rows of the visible columns with ``_sign``: -1 for what was, 1 for what is."""
    both = F.array(F.struct(F.lit(-1).alias("_sign"), F.col("prev").alias("_row")), F.struct(F.lit(1).alias("_sign"), F.col("curr").alias("_row")))
    return changes.select(F.inline(both)).where("_row is not null").select("_sign", "_row.*")


def deltas(changes: DataFrame, groups: list[tuple[str, str]], aggregates: list[tuple[str, str, str]]) -> DataFrame:
    """(k, group columns, aggregates, _rows): per touched group, what the batch adds to each sum and count.

    ``groups``: (expression, name); ``aggregates``: (``sum`` or ``count``, argument or ``*``, name).
    """
    rows = signed(changes)
    picked = rows.select("_sign", *[F.expr(e).alias(n) for e, n in groups], *[(F.lit(1) if a == "*" else F.expr(a)).alias(f"_in_{n}") for _, a, n in aggregates])
    sums = []
    for f, _, n in aggregates:
        x = F.col(f"_in_{n}")
        if f == "count":
            sums.append(F.sum(F.when(x.isNotNull(), F.col("_sign")).otherwise(0)).cast("bigint").alias(n))
        else:
            sums.append(F.sum(x * F.col("_sign")).alias(n))
            sums.append(F.sum(F.when(x.isNotNull(), F.col("_sign")).otherwise(0)).cast("bigint").alias(f"{n}_n"))
    names = [n for _, n in groups]
    grouped = picked.groupBy(*names).agg(*sums, F.sum("_sign").cast("bigint").alias("_rows"))
    return grouped.withColumn("k", key_of(*names))


def merged(state: DataFrame, added: DataFrame, groups: list[str], aggregates: list[tuple[str, str, str]], keep_empty: bool = False) -> DataFrame:
    """(k, prev, curr) of aggregation states from the stored ``state(k, row)`` and ``deltas``.

    A group whose last row goes is deleted, or with ``keep_empty`` stays with zeros.
    """
    fields = [n for f, _, n in aggregates for n in ([n, f"{n}_n"] if f == "sum" else [n])] + ["_rows"]
    joined = added.join(state.select("k", F.col("row").alias("prev")), "k", "left")
    total = {f: F.coalesce(F.col(f"prev.{f}"), F.lit(0)) + F.coalesce(F.col(f), F.lit(0)) for f in fields}
    curr = F.struct(*[F.col(g) for g in groups], *[total[f].cast(added.schema[f].dataType).alias(f) for f in fields])
    if not keep_empty:
        curr = F.when(total["_rows"] > 0, curr)
    return joined.select("k", "prev", curr.alias("curr")).where("prev is not null or curr is not null")


def value_deltas(changes: DataFrame, groups: list[tuple[str, str]], values: list[tuple[str, str]]) -> DataFrame:
    """(k, group columns, value columns, _rows): how many more (or less) rows a batch has of each group's values.

    ``k`` is the group's key, a separator and the values' key, so that a group's values stand in one bucket.
    """
    names, given = [n for _, n in groups], [n for _, n in values]
    rows = signed(changes).select("_sign", *[F.expr(e).alias(n) for e, n in [*groups, *values]])
    added = rows.groupBy(*names, *given).agg(F.sum("_sign").cast("bigint").alias("_rows")).where("_rows <> 0")
    return added.withColumn("k", F.concat(key_of(*names), F.lit(PART), key_of(*given)))


def of_values(values: DataFrame, groups: list[str], aggregates: list[tuple[str, str, str]], given: dict[str, str]) -> DataFrame:
    """(k, curr): groups' aggregates from their counted values ``values(k, row)``, k being the group's key.

    ``aggregates``: (function, argument, name); ``given``: the column of each argument. Sums and counts weigh a value by
    its rows, functions that repeats don't change take it once, and any other takes it as often as it occurs.
    """
    rows = values.select(F.substring_index("k", PART, 1).alias("k"), "row.*")
    if not all(f in ("sum", "count", *ONCE) or a.startswith("distinct ") for f, a, _ in aggregates):
        rows = rows.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_one").withColumn("_rows", F.lit(1).cast("bigint"))
    out = []
    for f, a, n in aggregates:
        distinct = "distinct " if a.startswith("distinct ") else ""
        x = given.get(a)
        if f == "count" and not distinct:
            out.append(F.sum(F.when(F.col(x).isNotNull(), F.col("_rows")).otherwise(0) if x else F.col("_rows")).alias(n))
        elif f == "sum" and not distinct:
            out.append(F.sum(F.col(x) * F.col("_rows")).alias(n))
        else:
            out.append(F.expr(f"{f}({distinct}{x})").alias(n))
    grouped = rows.groupBy("k", *groups).agg(*out, F.sum("_rows").alias("_rows"))
    return grouped.select("k", F.struct(*groups, *[n for _, _, n in aggregates], "_rows").alias("curr"))
