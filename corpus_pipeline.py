"""From raw documents to training tokens: five stages over the operators of ``tideline.llm``.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of ``documents``; the last
returns each document's tokens. ``run`` writes every stage's result to the shared folder and reads it back, so a lost
executor costs one stage at most; what a stage wrote on its way, and its input, go when its result is there. Only the
stage's own input decides: labels and benchmark are read from ``sf_dir``.

All stages take nulls in any column, empty and very long texts (whole), ties, repeated rows, empty tables and extra
columns of any name, which stay; each says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bpe import bpe_encode
from tideline.llm.common import discard, read, stored, stored_whole
from tideline.llm.decontaminate import drop_contaminated
from tideline.llm.near_dedup import class_of, near_duplicates
from tideline.llm.quality_rules import keep_quality
from tideline.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or the proven level of their language; null and empty texts fail.

    Null languages are a language of their own, repeated rows are judged alike, ratios equal to a cutoff pass.
    """
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group (five-word shingles, similarity 0.8 or more).

    Rows with a null doc_id stay. Of rows that share a doc_id, those that are in one group (or have no words) are one
    document, of which the least text stays; rows with other texts are documents of their own.
    """
    found = stored(near_duplicates(docs, k=5, percent=80), "groups")
    gone = found.where(~F.col("kept")).select("doc_id")
    repeats = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = stored(repeats.select("doc_id"), "repeated")
    once = stored(gone.union(twice).distinct().withColumnRenamed("doc_id", "__gone"), "gone")
    left = docs.join(once, F.col("doc_id") == F.col("__gone"), "left_anti")
    if twice.limit(1).count():  # texts of these ids meet their classes; all other texts move once
        allowed = found.where("kept").join(twice, "doc_id").select(F.col("doc_id").alias("__id"), F.col("cls").alias("__cls"), F.col("component").alias("__group")).distinct()
        own = docs.join(twice.withColumnRenamed("doc_id", "__gone"), F.col("doc_id") == F.col("__gone"), "left_semi")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rows = own.select(F.col("doc_id").alias("__id"), row.alias("__row"), class_of(F.col("text").cast("string")).alias("__cls"))
        same = rows["__cls"].eqNullSafe(allowed["__cls"]) & (rows["__id"] == allowed["__id"])
        rows = rows.join(allowed, same).select(allowed["__id"], "__group", "__row")
        least = F.min_by("__row", F.struct(F.col("__row.text"), F.to_json("__row")))
        left = left.unionByName(rows.groupBy("__id", "__group").agg(least.alias("__row")).select("__row.*"))
    return left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also an edited copy, and with them all rows of their doc_id.

    Rows with a null doc_id stay, null and empty texts hold nothing, repeated items count once.
    """
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every row stays, null and empty texts as they are."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of every row; null texts count as empty."""
    return bpe_encode(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("secret scans", secrets), ("byte-level BPE", encode)]

#: MinHash candidates, local alignment and byte-pair merges are no SQL: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored_whole(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
