"""Operator 9: language identification by Bayesian evidence fusion.

A row's posterior over languages is the product of

* the text's likelihood under each language's character model (Kneser-Ney, order 4, trained on the documents by their
  declared language), tempered to the weight of at most ``WEIGHT`` independent characters;
* how likely each language is to go with the declared markup language (``<html lang>``, or the column ``lang``);
* a prior of the row's host, smoothed towards its domain's, that towards its address suffix's, that towards the prior
  of all rows: at each level (counts + strength * parent) / (rows + strength).

The counts behind the last two are sums of the text-only posteriors, by grouped aggregation over all rows.

The languages are all that documents with text declare, however many and however rare: a row in any other gets the nearest
of them; a tag that no text comes with can't be told by text. Without a single declared language all rows are ``und``. A
task scores its rows by the models of one block of languages after another (see ``charlm``); likelihoods, sums and priors
are arrays with an element for each language, summed as rows by element. So work and stored likelihoods grow with rows
times languages, and what a task or the driver holds does not, but for arrays of one number a language.

Rows without text go by declaration and host alone; null or unknown declarations and hosts are values like others
(none); ties go to the first language of the list. Every row gives one row, null ids included; repeated rows count as
often as they occur; texts are judged whole, however long; empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import Shared, count_grams, declared_language, dense_of, gram_rows, kneser_ney, languages_of, shared_models
from .common import bare, discard, read, stored, text_buffers
from .html import main_text

WEIGHT, STRENGTH, SMOOTH = 60.0, 8.0, 0.5
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) from ``pages(page_id, url, html)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                htmls = [x.as_py() or "" for x in part.column(2)]
                found = [m[1].lower() if (m := _LANG.search(h)) else None for h in htmls]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(h) for h in htmls], pa.string()), pa.array(found, pa.string()), part.column(1)], names=["page_id", "text", "declared", "url"])

    own = bare(pages, page_id="bigint", url="string", html="string").mapInArrow(run, "page_id bigint, text string, declared string, url string")
    return own.select("page_id", "text", "declared", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)).alias("host"))


def likelihoods(rows: DataFrame, models: list[Shared], languages: tuple[str, ...]) -> DataFrame:
    """``rows(doc_id, page_id, text, declared, host)`` with tempered log-likelihoods ``ll``, one a language, instead of the text."""
    n = len(languages)

    def run(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            out = np.zeros((batch.num_rows, n))
            for shared in models:
                table = dense_of(shared)
                for i, j, g, starts, ends in gram_rows(raw, off):
                    at = np.column_stack((starts, ends)).ravel()[:-1]  # the last row ends with the n-grams
                    size = ends - starts
                    weight = np.where(np.diff(off[i : j + 1]) > 0, np.minimum(WEIGHT, size), 0) / size
                    for p in range(shared.pools):
                        out[i:j, shared.first + p] = np.add.reduceat(table[p][g], at, dtype=np.float64)[::2] * weight
            out -= out.max(axis=1, keepdims=True)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), ll], names=["doc_id", "page_id", "declared", "host", "ll"])

    return rows.mapInArrow(run, "doc_id bigint, page_id bigint, declared string, host string, ll array<double>")


def _log_total(logs: Column) -> Column:
    """log of the sum of exponentials; the greatest goes along, as an expression inside a lambda is evaluated for each element."""
    start = F.struct(F.array_max(logs).alias("top"), F.lit(0.0).alias("sum"))
    return F.aggregate(logs, start, lambda a, x: F.struct(a["top"].alias("top"), (a["sum"] + F.exp(x - a["top"])).alias("sum")), lambda a: a["top"] + F.log(a["sum"]))


def _summed(elements: DataFrame, *keys: str) -> DataFrame:
    """Vectors ``v`` whose elements are, in each group, sums of ``elements(_k, _x)``."""
    by_element = elements.groupBy(*keys, "_k").agg(F.sum("_x").alias("_x"))
    return by_element.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_x"))).alias("v")).select(*keys, F.col("v._x").alias("v"))


def fuse(scored: DataFrame, langs: tuple[str, ...], strength: float = STRENGTH) -> DataFrame:
    """Adds lang, confidence and text_lang to ``scored``, the output of ``likelihoods``; these may also be columns ``ll_<language>``."""
    if "ll" not in scored.columns:
        scored = scored.withColumn("ll", F.array(*[F.col(f"ll_{x}") for x in langs]))
    df = scored.select("doc_id", "page_id", F.coalesce("declared", F.lit("")).alias("declared"), "host", "ll")
    soft = df.withColumn("all", _log_total(F.col("ll"))).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    # a row's vector: 1 for the row itself, then its text-only posteriors
    soft = soft.select("host", "domain", "suffix", "declared", "all", F.posexplode(F.concat(F.array("all"), "ll")).alias("_k", "_x")).withColumn("_x", F.exp(F.col("_x") - F.col("all")))
    hosts = stored(_summed(soft, "host", "domain", "suffix"), "hosts")
    sums = hosts.select("host", "domain", "suffix", F.posexplode("v").alias("_k", "_x"))
    rows, *total = _summed(sums).first()["v"] or [0.0] * (1 + len(langs))  # one row
    prior = F.array(*[F.lit((t + SMOOTH) / (rows + SMOOTH * len(langs))) for t in total])

    def smoothed(parents: Column) -> Column:
        return F.zip_with(F.slice("v", 2, len(langs)), parents, lambda x, p: (x + strength * p) / (F.col("v")[0] + strength))

    suffixes = _summed(sums, "suffix").select("suffix", smoothed(prior).alias("s"))
    domains = _summed(sums, "domain", "suffix").join(suffixes, "suffix").select("domain", "suffix", smoothed(F.col("s")).alias("d"))
    priors = hosts.join(domains, ["domain", "suffix"]).select("host", F.transform(smoothed(F.col("d")), lambda x: F.log(x)).alias("h"))
    shares = F.zip_with(F.slice("v", 2, len(langs)), F.array(*[F.lit(t + SMOOTH) for t in total]), lambda x, t: F.log((x + SMOOTH) / t))
    declared = _summed(soft, "declared").select("declared", shares.alias("c"))
    joined = df.join(stored(declared, "declared"), "declared").join(stored(priors, "priors"), "host")
    joined = joined.withColumn("post", F.zip_with(F.zip_with("ll", "c", lambda x, y: x + y), "h", lambda x, y: x + y))
    joined = joined.withColumn("best", F.array_max("post"))
    name = lambda logs, best: F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(logs, best).cast("int"))
    confidence = F.exp(F.col("best") - _log_total(F.col("post")))
    has_text = F.exists("ll", lambda x: x != 0)
    return joined.select(
        "doc_id", "page_id", name("post", F.col("best")).alias("lang"), F.round(confidence, 6).alias("confidence"), F.nullif("declared", F.lit("")).alias("declared"), F.when(has_text, name("ll", F.array_max("ll"))).alias("text_lang")
    )


def identify_language(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, confidence, declared, text_lang): a row for each document and each page.

    A document's declared language is its column ``lang``, its host its ``source``.
    """
    own = bare(docs, doc_id="bigint", text="string", lang="string", source="string").withColumn("lang", declared_language(F.col("lang")))
    languages = languages_of(own.where(F.col("text").rlike(r"\S"))) or ("und",)
    grams = stored(count_grams(own.where(F.col("lang").isin(*languages)), languages), "grams")
    model = stored(kneser_ney(grams), "language-models")
    models = shared_models(model, len(languages))
    a = own.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"), F.lower(F.coalesce("source", F.lit(""))).alias("host"))
    b = page_texts(pages).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", "text", "declared", "host")
    scored = stored(likelihoods(a, models, languages).unionByName(likelihoods(b, models, languages)), "likelihoods")
    discard(grams, model)
    for shared in models:
        shared.arrays.destroy()
    return fuse(scored, languages)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages"))
