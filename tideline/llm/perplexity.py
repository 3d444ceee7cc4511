"""Operator 5: quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trusted are documents labelled good and not toxic. N-grams are of order 4 over characters as they stand, of any script
(white space counts as one character, digits as another, code points from ``FOLD`` on share the symbols above it), and
are counted over whole texts and all trusted documents but one in ``HELD``, so the model grows with the corpus. Those held
out, by a hash of doc_id, set the thresholds: a text that a model has learned from is no measure of texts that are new to
it. A document's perplexity is that of its language's model; it is kept if that is at most the language's ``quantile`` of
the documents held out, to the next thousandth of its logarithm: quantiles are counted in such steps, over all of these,
and don't depend on how rows are dealt.

Counts and scores meet as tables, sharded by n-gram or context; no task and no driver holds a model. What moves is not
each document's n-grams but those of blocks of some ``BLOCK`` bytes of text, each once: documents are written in blocks,
bucketed by them; a block asks for its distinct n-grams (which also carry their counts in the block's trusted texts), the
shares of all n-grams asked for are computed once, order by order, and the answers go back to the block, whose texts are
read where they lie and scored. Texts themselves are never shuffled.

Null or empty texts have no perplexity and aren't kept. Languages without a model of their own (see ``pools_of``) and null
share one pooled model; without a threshold (no text of its pool held out) all of a pool's non-empty documents are kept.
Repeated rows and null ids give results row by row, null ids are never trusted; a document labelled more than once is
trusted only if each label is good; a perplexity equal to the threshold is kept. Texts are scored whole, however long;
empty tables give no rows, without labels every non-empty document is kept; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .charlm import ORDER, OTHER, Alphabet, declared_language, gram_rows, kneser_ney, pool_of
from .common import bare, discard, read, stored, stored_in_buckets, text_buffers

QUANTILE = 0.995
#: Languages with a model of their own; other values and null share the model ``other``.
MOST_LANGUAGES, LEAST_SHARE = 10, 0.01
HELD = 5
BLOCK = 1 << 24  # bytes of text that ask for their n-grams together; a longer text stands with what is left of its block
MOST_BUCKETS = 100_000  # the most that Spark allows
FOLD, SIZE = 54_000, 55_000  # SIZE**4 < 2**63

_PLAIN = np.arange(FOLD, dtype=np.int64)
_PLAIN[[i for i in range(FOLD) if chr(i).isspace()]] = 0
_PLAIN[48:58] = 48


def _characters(points: np.ndarray) -> np.ndarray:
    out = _PLAIN[np.minimum(points, FOLD - 1)]
    high = points >= FOLD
    if high.any():
        out[high] = FOLD + points[high].astype(np.int64) % (SIZE - FOLD)
    return out


CHARACTERS = Alphabet(SIZE, _characters)


def pools_of(docs: DataFrame) -> tuple[str, ...]:
    """The declared languages of ``docs(lang)`` that get a model of their own, the most frequent first."""
    seen = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    known = seen.where(F.col("lang").isNotNull() & (F.col("n") >= LEAST_SHARE * total)).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    return tuple(r.lang for r in known.collect())


def trusted(labels: DataFrame) -> DataFrame:
    known = bare(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id is not null")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return known.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0


def blocks(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(block, doc_id, pool, text) of ``docs(doc_id, text, lang)``: a block is consecutive rows of one task."""

    def run(batches):
        first, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            ends = held + np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([held], ends))
            held = int(starts[-1])
            pools = pa.array([pool_of(x, languages) for x in batch.column(2).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(first + starts[:-1] // BLOCK), batch.column(0), pools, text], names=["block", "doc_id", "pool", "text"])

    return docs.mapInArrow(run, "block bigint, doc_id bigint, pool int, text string")


def _chunks(table: pa.Table):
    """Per chunk of a block's texts: (rows, each n-gram's row, n-grams, each n-gram's pool), empty texts without n-grams."""
    raw, off = text_buffers(table["text"])
    pools = table["pool"].to_numpy()
    for i, j, g, starts, ends in gram_rows(raw, off, CHARACTERS):
        row = np.repeat(np.arange(j - i), np.diff(np.append(starts, len(g))))
        inside = (np.arange(len(g)) < ends[row]) & (np.diff(off[i : j + 1]) > 0)[row]
        row = row[inside] + i
        yield slice(i, j), row, g[inside], pools[row]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, own = pd.factorize(keys)
    return own, np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)


def requests(texts: DataFrame, good: DataFrame) -> DataFrame:
    """(block, pool, g, c): each block's n-grams and their counts in its trusted texts, of ``good(block, doc_id)``."""

    def run(texts: pa.Table, good: pa.Table) -> pa.Table:
        ids = texts["doc_id"]
        trust = pc.fill_null(pc.is_in(ids, value_set=good["doc_id"].combine_chunks()), False).to_numpy().astype(np.float64) if len(good) else np.zeros(len(ids))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, row, g, pool in _chunks(texts):
            for p in np.unique(pool).tolist():
                of = pool == p
                keys, counts = _summed(g[of], trust[row[of]])
                if p in held:
                    keys, counts = _summed(np.concatenate((held[p][0], keys)), np.concatenate((held[p][1], counts)))
                held[p] = keys, counts
        n = sum(len(k) for k, _ in held.values())
        block = texts["block"][0].as_py() if len(texts) else 0
        nothing = np.zeros(0, dtype=np.int64)
        return pa.table(
            {
                "block": pa.array(np.full(n, block, dtype=np.int64)),
                "pool": pa.array(np.concatenate([nothing, *[np.full(len(k), p) for p, (k, _) in held.items()]]).astype(np.int32)),
                "g": pa.array(np.concatenate([nothing, *[k for k, _ in held.values()]])),
                "c": pa.array(np.concatenate([nothing, *[c for _, c in held.values()]])),
            }
        )

    return texts.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(run, "block bigint, pool int, g bigint, c bigint")


def shares(seen: DataFrame, model: DataFrame) -> DataFrame:
    """(pool, g, p): the interpolated probability of each n-gram of ``seen(pool, g)``, order by order from the uniform law.

    ``model`` has the rows of ``kneser_ney``; an n-gram it lacks has its context's weight of the order below, and all of
    that where it lacks the context too.
    """
    lower = None
    for n in range(1, ORDER + 1):
        need = seen.select("pool", "g") if n == ORDER else seen.select("pool", F.expr(f"g % {SIZE**n}L").alias("g")).distinct()
        of = model.where(F.col("n") == n)
        alpha = of.where("key >= 0").select("pool", F.col("key").alias("g"), F.col("value").alias("alpha"))
        gamma = of.where("key < 0").select("pool", (-1 - F.col("key")).alias("ctx"), F.col("value").alias("gamma"))
        own = need.withColumn("ctx", F.expr(f"g div {SIZE}")).withColumn("rest", F.expr(f"g % {SIZE ** (n - 1)}L"))
        own = own.join(alpha, ["pool", "g"], "left").join(gamma, ["pool", "ctx"], "left")
        own = own.withColumn("back", F.lit(1.0 / SIZE)) if lower is None else own.join(lower.select("pool", F.col("g").alias("rest"), F.col("p").alias("back")), ["pool", "rest"])
        lower = own.select("pool", "g", (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("back")).alias("p"))
    return lower


def perplexities(texts: DataFrame, answers: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(doc_id, pool, perplexity) of every row of the blocks, by ``answers(block, pool, g, score)``."""
    names = pa.array([*languages, OTHER], pa.string())

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pool_of_answer, keys, scores = (answers[c].to_numpy() for c in ("pool", "g", "score"))
        known = {}
        for p in np.unique(pool_of_answer).tolist():
            at = np.flatnonzero(pool_of_answer == p)
            known[p] = pd.Index(keys[at]), scores[at]
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, row, g, pool in _chunks(texts):
            value = np.zeros(len(g))
            for p in np.unique(pool).tolist():
                of = np.flatnonzero(pool == p)
                value[of] = known[p][1][known[p][0].get_indexer(g[of])]
            size = rows.stop - rows.start
            total[rows] = np.bincount(row - rows.start, weights=value, minlength=size)
            n[rows] = np.bincount(row - rows.start, minlength=size)
        out = np.exp(-total / np.maximum(n, 1))
        return pa.table({"doc_id": texts["doc_id"], "pool": names.take(texts["pool"].combine_chunks()), "perplexity": pa.array(out, pa.float64(), mask=n == 0)})

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id bigint, pool string, perplexity double")


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(pool, threshold) of ``values(pool, perplexity)``: the least step of a thousandth (of the logarithm) that has so large a
    share of a pool's values at or below it."""
    steps = values.where("perplexity is not null").select("pool", F.ceil(F.log("perplexity") * 1000 - 1e-9).alias("step")).groupBy("pool", "step").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("pool").orderBy("step")  # some thousand steps, whatever the number of rows
    ranked = steps.withColumn("below", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("pool")))
    return ranked.where(F.col("below") >= quantile * F.col("all")).groupBy("pool").agg(F.exp(F.min("step") / 1000 + 1e-9).alias("threshold"))


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, pool, perplexity, threshold, kept) of every row of ``docs(doc_id, text, lang)``."""
    own = bare(docs, doc_id="bigint", text="string", lang="string").withColumn("lang", declared_language(F.col("lang")))
    languages = pools_of(own)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = stored_in_buckets(blocks(own, languages), "blocks", min(MOST_BUCKETS, max(32, -(-size // BLOCK))), "block")
    good = stored(trusted(labels), "trusted")
    learned = stored(texts.select("block", "doc_id").join(good.where(~held_out()), "doc_id", "left_semi"), "learned")
    asked = stored(requests(texts, learned), "asked")
    seen = stored(asked.groupBy("pool", "g").agg(F.sum("c").alias("c")), "seen")
    model = stored(kneser_ney(seen.where("c > 0"), SIZE), "kneser-ney")
    answers = asked.join(shares(seen, model), ["pool", "g"]).select("block", "pool", "g", F.log("p").alias("score"))
    scored = stored(perplexities(texts, answers, languages), "perplexity")
    limits = stored(quantiles(scored.join(good.where(held_out()), "doc_id", "left_semi"), quantile), "limits")
    discard(texts, learned, asked, seen, model, good)
    joined = scored.join(F.broadcast(limits), "pool", "left")  # a row for each pool
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select("doc_id", "pool", "perplexity", "threshold", kept.alias("kept"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
