import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import decontaminate, near_dedup
from tideline.llm.components import components
from tideline.llm.words import U, shingle_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_groups(rows, k, percent):
    """(doc_id, set size, least doc_id reachable) of each row with an id, by comparing all pairs."""
    rows = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(rows))


def found(docs, **kw):
    out = near_dedup.near_duplicates(docs, **kw).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_all_pairs(clashing, corpus, k, percent):
    assert found(clashing, k=k, percent=percent) == plain_groups(corpus, k, percent)


def test_a_large_family_without_all_pairs(spark, monkeypatch):
    """Chains, drift and a hub: several components within buckets, blocks far smaller than the family."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(8)
    pool = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(pool) for _ in range(60)]
    rows, last = [], base
    for i in range(150):
        w = list(last if i % 3 else base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(pool)
        last = w
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, k=3, percent=85) == plain_groups(rows, 3, 85)


def test_empty_tables(docs, clashing):
    assert found(docs.limit(0), k=3, percent=85) == []
    assert found(docs.where("doc_id is null"), k=3, percent=85) == []


def test_estimates_are_corrected_for_collisions():
    rnd = np.random.RandomState(1)
    a = rnd.randint(0, 2**62, 2000, dtype=np.int64).astype(U)
    for share in (0.0, 0.5, 0.85):
        cut = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:cut], rnd.randint(0, 2**62, 2000 - cut, dtype=np.int64).astype(U)])
        x, y = (np.frombuffer(near_dedup.packed(near_dedup.minima(s << U(1))), np.uint8) for s in (a, b))
        assert abs(float(near_dedup.estimated(x, y)) - share) < 0.12


def test_links_at_the_threshold():
    a = np.arange(0, 100, dtype=U)
    assert near_dedup.is_link(a, np.arange(0, 85, dtype=U), 85)
    assert not near_dedup.is_link(a, np.arange(0, 84, dtype=U), 85)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_words_that_a_polynomial_confuses(spark):
    """A Thue-Morse word and its complement: equal under any polynomial modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id bigint, text string")
    assert found(df, k=3, percent=85) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "WEIGHT", 8)
    rows = [(k, f"c{c}", bytes([c, k]), bytes(8), 16) for k in range(2) for c in range(40)]
    df = spark.createDataFrame([(k, c, bytearray(x), bytearray(s), w) for k, c, x, s, w in rows], "key bigint, comp string, cls binary, sig binary, weight bigint")
    sizes = near_dedup._blocks(df, ["cls"]).groupBy("key", "x", "y").count().collect()
    assert max(r["count"] for r in sizes) <= 12  # of weight 16 each, where a block may hold 16


def test_classes_of_texts(spark, corpus):
    df = spark.createDataFrame([*corpus[:60], *corpus[100:112]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = df.select("text", near_dedup.class_of(F.col("text"), 5).alias("c")).collect()
    by = {}
    for r in got:
        by.setdefault(r.c and bytes(r.c), set()).add(shingles(r.text, 5))
    assert all(len(v) == 1 for v in by.values()) and by[None] == {frozenset()}


def test_words_and_shingles():
    texts = ["A b  c", "", "one", "x\x0by\x1cz é", " lead", "trail \n"]
    raw = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    row, start, end, h = words(np.frombuffer(raw, np.uint8), off)
    got = [[raw[a:b].decode() for r, a, b in zip(row, start, end, strict=True) if r == i] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    again, bounds = shingle_hashes(row, h, 3, len(texts))
    assert list(np.diff(bounds)) == [1, 0, 1, 1, 1, 1]
    assert len(set(again.tolist())) == 5


# -- benchmark leaks -----------------------------------------------------------------------------------------------------
def plain_score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_plain_recurrence():
    rnd = np.random.RandomState(4)
    for _ in range(150):
        a, b = rnd.randint(0, 6, rnd.randint(1, 12)), rnd.randint(0, 6, rnd.randint(1, 30))
        assert decontaminate.smith_waterman(a, b)[0] == plain_score(a, b)


def leaks(spark):
    rnd = random.Random(11)
    pool = ["the", "of", "and"] + [f"{rnd.choice('abcdefgh')}{i}" for i in range(900)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(12, 50)))) for i in range(12)]
    docs, want = [], set()
    for i in range(120):
        w = [rnd.choice(pool) for _ in range(rnd.randint(20, 300))]
        if i % 3 == 0:
            item = rnd.randrange(12)
            copy = items[item][1].split(" ")
            for _ in range(len(copy) // 6 if i % 2 else 0):  # edits
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[], ["new"], [copy[at], "more"]])
            text = " ".join(copy)
            at = rnd.randrange(len(w))
            w[at:at] = [text.upper() if i % 9 == 0 else text.replace(" ", ", ")]
            want.add((i, item))
        docs.append((i, " ".join(w)))
    return items, docs, want


def test_edited_copies_are_found_and_clean_texts_left_alone(spark):
    items, docs, want = leaks(spark)
    b = spark.createDataFrame([*items, (None, "a b c d"), (50, None), (51, ""), (52, "two words"), (60, items[0][1])], "item_id bigint, text string")
    df = spark.createDataFrame([*docs, (500, None), (501, ""), (502, "Two words!"), (None, items[0][1])], "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as score")
    extra = {(d, 60) for d, i in want if i == 0} | {(502, 52), (None, 0), (None, 60)}
    for block in (5, 1000):
        got = decontaminate.contaminated(df, b, item_block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | extra
        assert all(0.4 <= r.score <= 1 for r in got)
    left = decontaminate.drop_contaminated(df, b)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want} | {500, 501, None}
    assert decontaminate.contaminated(df, b.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), b).count() == 0


def test_a_passage_in_every_document_is_found_in_all(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("start "), F.lit(item), F.concat(F.lit(" end"), "id")).alias("text"))
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert decontaminate.contaminated(df, b).count() == 300


def test_every_copy_that_scores_enough_is_found(spark):
    """Heavily edited copies, halves, a half that most documents share, and the pairs that plain alignment finds."""
    rnd = random.Random(3)
    pool = ["the", "of", "and"] + [f"{rnd.choice('abcdefgh')}{i}" for i in range(300)]
    items = [[rnd.choice(pool) for _ in range(n)] for n in (3, 4, 6, 12, 15, 20, 28, 35, 48, 59)]
    docs = []
    for item in items:
        n = len(item)
        for share in (0.2, 0.25, 0.3):
            for _ in range(3):
                docs.append([rnd.choice([[], ["new"], [w, "more"]]) if rnd.random() < share else [w] for w in item])
        docs += [[[w] for w in item[: (n + 1) // 2]], [[w] for w in item[n // 2 :]], [[w, "x"] for w in item], [[w] if i % 3 else ["y"] for i, w in enumerate(item)]]
    docs = [[rnd.choice(pool) for _ in range(rnd.randint(0, 30))] + sum(d, []) + [rnd.choice(pool) for _ in range(rnd.randint(0, 30))] for d in docs]
    docs += [[*items[7][:10], rnd.choice(pool)] for _ in range(60)]
    want = {(i, k): s for i, d in enumerate(docs) for k, item in enumerate(items) if (s := plain_score(item, d)) >= max(0.8 * len(item), 6)}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.score * 2 * len(items[r.item_id])) for r in decontaminate.contaminated(df, b).collect()}
    assert got == want
