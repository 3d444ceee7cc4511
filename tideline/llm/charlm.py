"""Character n-gram counts and interpolated modified Kneser-Ney models over a fixed alphabet.

In ``CLASSES`` characters fall into 40 symbols: white space, 26 lower-case ASCII letters, and classes for capitals, digits, clause marks,
other punctuation, ``!``, symbols and the rest; other lower-case letters and letters without case fall into three
classes each, by their code points, so that order within words tells text from noise in any script. So an n-gram is a
number below 40**n, and a model of order 4 has at most 40**4 + 40**3 + 40**2 + 40 entries per language: a bound that no
corpus exceeds. Counts cover all of the given text; they are summed per task before the shuffle.

The languages are all that the documents declare, by grouped aggregation over all of them. ``AT_ONCE`` bounds the models
that a task or the driver holds at a time, not their number: models are broadcast in blocks of so many, and counts of
pools beyond the first so many are summed in sorted runs.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, text_buffers

SYMBOLS, ORDER = 40, 4
#: Models that are held at a time, and n-grams that a task holds of the pools that have no dense counts.
AT_ONCE, MOST_HELD = 5, 1 << 20
#: The pool of the values, and of null, that have no model of their own.
OTHER = "other"


def declared_language(lang: Column) -> Column:
    """The language of a tag such as en-US, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(lang.cast("string"), "^[A-Za-z]*", 0)), F.lit(""))


def languages_of(docs: DataFrame) -> tuple[str, ...]:
    """All declared languages of ``docs(lang)``, the most frequent first."""
    seen = docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return tuple(r.lang for r in seen.orderBy(F.desc("n"), "lang").collect())  # a row for each language


def _class_of(c: str) -> int:
    if c.isspace():
        return 0
    if "a" <= c <= "z":
        return 1 + ord(c) - 97
    kind = unicodedata.category(c)
    if kind in ("Lu", "Lt"):
        return 27
    if kind == "Ll":
        return (28, 36, 37)[ord(c) % 3]
    if kind[0] == "N":
        return 29
    if c in ".,":
        return 30
    if c == "!":
        return 32
    if c in ";:?'\"-()’‘“”«»–—¿¡":
        return 31
    if kind[0] in "SP":
        return 33
    return (34, 38, 39)[ord(c) % 3] if kind[0] in "LM" else 35


class Alphabet(NamedTuple):
    """``size`` symbols; ``of`` maps code points to them, white space to 0. A number of ORDER symbols fits 63 bits."""

    size: int
    of: Callable[[np.ndarray], np.ndarray]


_TABLE = np.array([_class_of(chr(i)) if not 0xD800 <= i < 0xE000 else 35 for i in range(0x10000)], dtype=np.uint8)


_CASELESS = np.array([34, 38, 39], dtype=np.uint8)
CLASSES = Alphabet(SYMBOLS, lambda points: np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], _CASELESS[points % 3]))


def symbols_of(raw: np.ndarray, off: np.ndarray, alphabet: Alphabet = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of UTF-8 rows and the rows' offsets into them; each row has white space before and after it."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    opens = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    sym = alphabet.of(points)
    n = len(off) - 1
    out = np.zeros(len(sym) + (ORDER - 1 + 1) * n, dtype=np.int64)
    row = np.repeat(np.arange(n), np.diff(opens))
    out[np.arange(len(sym)) + (row + 1) * (ORDER - 1) + row] = sym
    return out, opens + np.arange(n + 1) * ORDER


def grams_of(sym: np.ndarray, size: int = SYMBOLS) -> np.ndarray:
    """The n-gram that ends at each position from ORDER - 1 on."""
    g = np.zeros(max(0, len(sym) - ORDER + 1), dtype=np.int64)
    for j in range(ORDER):
        g = g * size + sym[j : len(sym) - ORDER + 1 + j]
    return g


def gram_rows(raw: np.ndarray, off: np.ndarray, alphabet: Alphabet = CLASSES):
    """Per chunk of rows: (first row, last row, n-grams of the chunk, bounds of each row's n-grams).

    A row of n characters has n + 1 n-grams, each character's and the closing white space's; an empty row has none
    worth counting but keeps its one.
    """
    for i, j in batches_of(off):
        sym, bounds = symbols_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], alphabet)
        g = grams_of(sym, alphabet.size)
        ends = bounds[1:]
        starts = bounds[:-1]
        yield i, j, g, starts, ends - (ORDER - 1)


def pool_of(lang: str | None, languages: tuple[str, ...]) -> int:
    return languages.index(lang) if lang in languages else len(languages)


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of runs of (keys, counts), sorted, with the sums of their counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in runs]), return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in runs]))
    return keys, counts


def _count_rows(pool: np.ndarray, g: np.ndarray, c: np.ndarray):
    for at in range(0, len(g), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(pool[s].astype(np.int32)), pa.array(g[s].astype(np.int32)), pa.array(c[s].astype(np.int64))], names=["pool", "g", "c"])


def count_grams(docs: DataFrame, languages: tuple[str, ...], most_held: int = MOST_HELD) -> DataFrame:
    """(pool, g, c): n-grams of ``docs(text, lang)`` in each language's pool and that of the others.

    A task counts the ``AT_ONCE`` most frequent pools in dense arrays, those beyond in runs of distinct n-grams, which it
    sends on, as partial sums, when they hold more than ``most_held``.
    """
    dense_pools, grams = min(len(languages) + 1, AT_ONCE), SYMBOLS**ORDER

    def run(batches):
        total = np.zeros((dense_pools, grams), dtype=np.int32)
        runs, held = [], 0
        for batch in batches:
            raw, off = text_buffers(batch.column(0))
            pools = np.array([pool_of(x, languages) for x in batch.column(1).to_pylist()])
            for i, j, g, starts, ends in gram_rows(raw, off):
                keep = np.zeros(len(g) + 1, dtype=np.int32)
                np.add.at(keep, starts, 1)
                np.add.at(keep, np.minimum(ends, len(g)), -1)
                inside = np.cumsum(keep[:-1]) > 0
                pool = np.repeat(pools[i:j], np.diff(np.append(starts, len(g))))
                for p in np.unique(pools[i:j]):
                    if p >= dense_pools:
                        continue
                    got = g[inside & (pool == p)]
                    if len(got):
                        total[p] += np.bincount(got, minlength=grams).astype(np.int32)
                late = inside & (pool >= dense_pools)
                if late.any():
                    runs.append(np.unique(pool[late] * grams + g[late], return_counts=True))
                    held += len(runs[-1][0])
                if held > most_held:
                    runs = [_merged(runs)]
                    held = len(runs[0][0])
                    if held > most_held // 2:
                        yield from _count_rows(runs[0][0] // grams, runs[0][0] % grams, runs[0][1])
                        runs, held = [], 0
        p, g = np.nonzero(total)
        yield from _count_rows(p, g, total[p, g])
        if runs:
            keys, counts = _merged(runs)
            yield from _count_rows(keys // grams, keys % grams, counts)

    part = docs.select("text", "lang").mapInArrow(run, "pool int, g int, c bigint")
    return part.groupBy("pool", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, size: int = SYMBOLS) -> DataFrame:
    """(n, pool, key, alpha, gamma): what modified Kneser-Ney smoothing needs, from ``counts(pool, g, c)``.

    Of order n, ``key`` is an n-gram with its discounted share ``alpha`` of the context, or, negative, -1 - context with
    the weight ``gamma`` that the context leaves to order n - 1. Orders below the highest use continuation counts. The
    count tables meet by (pool, context), which shards them over the cluster.
    """
    levels, level = [], counts.select("pool", F.col("g").cast("bigint").alias("g"), "c")
    for n in range(ORDER, 0, -1):
        own = level.withColumn("ctx", F.expr(f"g div {size}"))
        of = own.groupBy("pool").agg(*[F.sum((F.col("c") == k).cast("bigint")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        cut = lambda a, b, k: F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(b) / F.greatest(F.col(a), F.lit(1.0))))
        of = of.select("pool", cut("n1", "n2", 1).alias("d1"), cut("n2", "n3", 2).alias("d2"), cut("n3", "n4", 3).alias("d3"))
        ctx = own.groupBy("pool", "ctx").agg(F.sum("c").alias("total"), *[F.sum(cond.cast("bigint")).alias(f"m{k}") for k, cond in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
        ctx = ctx.join(F.broadcast(of), "pool")  # a row for each pool
        gamma = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        alpha = own.join(ctx, ["pool", "ctx"]).select(F.lit(n).alias("n"), "pool", F.col("g").alias("key"), ((F.col("c") - discount) / F.col("total")).alias("value"))
        levels += [alpha, ctx.select(F.lit(n).alias("n"), "pool", (-1 - F.col("ctx")).alias("key"), gamma.alias("value"))]
        level = level.groupBy("pool", F.expr(f"g % {size ** (n - 1)}L").alias("g")).agg(F.count(F.lit(1)).alias("c"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def model_arrays(model: DataFrame) -> tuple[np.ndarray, ...]:
    """The model's rows on the driver, for a broadcast; their number is bounded by alphabet, order and pools (``AT_ONCE`` in a block)."""
    t = model.toArrow()
    return tuple(t.column(c).to_numpy().astype(k) for c, k in (("n", np.int8), ("pool", np.int8), ("key", np.int32), ("value", np.float32)))


_dense: dict[str, np.ndarray] = {}


class Shared(NamedTuple):
    """Models of pools ``first`` to ``first + pools - 1``, broadcast; a name of their own, as workers outlive jobs and keep a table that they built."""

    name: str
    first: int
    pools: int
    arrays: Broadcast


def shared_models(model: DataFrame, pools: int) -> list[Shared]:
    """The models of all pools, in blocks of ``AT_ONCE``, of which the driver holds one at a time."""
    out = []
    for first in range(0, pools, AT_ONCE):
        n = min(AT_ONCE, pools - first)
        own = model.where(F.col("pool").between(first, first + n - 1)).withColumn("pool", F.col("pool") - first)
        out.append(Shared(uuid.uuid4().hex, first, n, model.sparkSession.sparkContext.broadcast(model_arrays(own))))
    return out


def dense_of(shared: Shared) -> np.ndarray:
    """The worker's table of a block of models, built when the block before it was another."""
    if shared.name not in _dense:
        _dense.clear()
        _dense[shared.name] = dense(shared.arrays.value, shared.pools)
        if hasattr(shared.arrays, "_path"):  # can be read again: a worker would hold the arrays of all blocks
            vars(shared.arrays).pop("_value", None)
    return _dense[shared.name]


def dense(arrays: tuple[np.ndarray, ...], pools: int) -> np.ndarray:
    """log p of every n-gram in every pool, float32 of (pools, 40**4); a pool without text has the uniform law."""
    n, pool, key, value = arrays
    out = np.zeros((pools, SYMBOLS**ORDER), dtype=np.float32)
    for p in range(pools):
        lower = np.full(1, 1.0 / SYMBOLS, dtype=np.float32)
        for k in range(1, ORDER + 1):
            here = (n == k) & (pool == p)
            rows, ctx = here & (key >= 0), here & (key < 0)
            gamma = np.ones(SYMBOLS ** (k - 1), dtype=np.float32)
            gamma[-1 - key[ctx]] = value[ctx]
            back = np.repeat(lower, SYMBOLS) if k == 1 else np.tile(lower, SYMBOLS)
            probability = np.repeat(gamma, SYMBOLS) * back[: SYMBOLS**k]
            probability[key[rows]] += value[rows]
            lower = probability
        out[p] = np.log(lower)
    return out
