import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tideline.llm import secrets
from tideline.llm.common import stored

from .test_dedup_and_leaks import shingles


def small(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture
def rows():
    rnd = random.Random(1)
    pool = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rnd.choice(pool) for _ in range(n))
    base = text(80)
    return [
        (0, base, "en"), (1, base, "en"), (2, base + " tail", "en"), (3, text(60), "de"), (4, "too short", "en"), (5, "same eight words in a row again yes " * 12, "en"),
        (6, text(30) + " alpha beta gamma delta epsilon zeta eta theta iota kappa " + text(30), "en"), (7, text(40) + " token = abcdefghijkl", "fr"), (8, None, None), (9, "", "en"), (None, text(50), "en"), (3, text(60), "de"),
    ]


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' as source", "length(text) as n_chars", "1 as n_words", "2 as _row")
    folder = str(tmp_path)
    small(spark, folder, docs)
    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = at.columns
        at = stored(stage(spark, at, folder), "stage")
        seen[name] = sorted((r[0] for r in at.select("doc_id").collect()), key=str)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == before
    assert seen["quality rules"] == sorted([0, 1, 2, 3, 3, 6, 7, None], key=str)
    assert seen["near duplicates"] == sorted([0, 3, 6, 7, None], key=str)
    assert seen["decontamination"] == sorted([0, 3, 7, None], key=str)
    assert seen["secret scans"] == seen["byte-level BPE"] == seen["decontamination"]


def test_secrets_leave_the_texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("n_chars", F.length("text").cast("bigint"))
    out = corpus_pipeline.secrets(spark, docs, "").collect()
    assert not any(secrets.find_secrets(r.text or "") for r in out)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_duplicates_stage_keeps_one_of_each_group(spark, corpus, docs):
    """Also of rows that share a doc_id: rows with other texts are documents of their own."""
    got = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").where("doc_id is not null").collect())
    known = [r for r in corpus if r[0] is not None]
    sets, want = [shingles(t, 5) for _, t, *_ in known], set()
    linked = lambda a, b: a == b or (bool(a and b) and 5 * len(a & b) >= 4 * len(a | b))
    for n, (i, _, *_) in enumerate(known):
        group, todo = {n}, [n]
        while todo:
            x = todo.pop()
            fresh = {m for m in range(len(known)) if m not in group and linked(sets[x], sets[m]) and (sets[x] or known[m][0] == i)}
            group |= fresh
            todo += fresh
        if i == min(known[m][0] for m in group):
            want.add((i, min((known[m][1] or "") for m in group if known[m][0] == i)))
    assert got == sorted(want)
    assert len([1 for i, _ in got if i == 7]) == 2  # two texts under one id


def test_a_run_leaves_only_its_result(spark, tmp_path, rows):
    import os

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' as source", "length(text) as n_chars")
    small(spark, str(tmp_path), docs)
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4
    assert len(set(os.listdir(folder)) - before) == 1


def test_run_over_empty_documents(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'s' as source", "length(text) as n_chars").limit(0)
    small(spark, str(tmp_path), docs)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
