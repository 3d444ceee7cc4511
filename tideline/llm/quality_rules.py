"""Operator 6: quality rules with risk-controlled thresholds. DataFrame and SQL functions only.

Each rule is a ratio that grows with junk. The rules' cutoffs tighten together, along one fixed sequence of levels from
loose to strict (``RULES``), and a document is rejected from the first level on at which any ratio is above its cutoff.
For each stratum (language) labelled documents choose a level: of the levels whose false-rejection rate among documents
labelled good is below ``alpha`` with confidence, the one with the best balance of rejected bad against rejected good
documents, and of equals the loosest. "With confidence" is exact: the binomial probability of seeing at most the
observed number of false rejections, were the rate ``alpha``, is at most ``delta`` divided by the number of strata
(Bonferroni). Within a stratum the levels are tested in their order and the first that fails ends the sequence, which
needs no further correction, since the order doesn't depend on the labels. So with probability 1 - delta, in every
stratum at once, the rules reject no more than ``alpha`` of the good documents. With the defaults and four strata that
takes some 220 good labels a stratum, if none of them is rejected; a stratum with too few labels to prove anything
rejects nothing beyond the base rule.

Null texts have no words, null languages form a stratum of their own; a document labelled more than once counts with
its lowest quality, labels without a doc_id or quality don't count; repeated rows give repeated results, ties (ratios
equal to a cutoff) pass; texts are measured whole, however long; empty tables give no rows, without labels only the base
rule rejects; other columns are ignored or, in ``keep_quality``, passed through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bare, discard, read, stored

WINDOW = 8
SPACES = "\t\n\x0b\x0c\r"
ALPHA, DELTA = 0.02, 0.05
#: What one rejected share of the good documents weighs against the same share of the bad ones.
WEIGHT = 10.0
#: Strata that are joined as a broadcast at most; beyond, the join shuffles.
BROADCAST_STRATA = 10_000

#: rule: (SQL of its ratio over the measures, cutoffs from loose to strict, one for each level).
RULES = {
    "symbols": ("n_symbols / n_words", [1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]),
    "bangs": ("n_bangs / n_words", [1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02]),
    "capitals": ("n_capitals / word_chars", [1.0, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "digits": ("n_digits / word_chars", [1.0, 0.75, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "dup_lines": ("n_dup_lines / n_lines", [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3]),
    "repeats": ("n_repeat_words / n_words", [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.28, 0.25]),
    "long_words": ("word_chars / n_words", [20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0]),
}
LEVELS = 10


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` and, per row, the columns that the rules need; ``docs`` must have ``text`` and none of these names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # windows of 8 words by doubling: hashes of 1, 2, 4 and then 8 words
    df = docs.withColumn("_t", text).withColumn("_w", F.array_remove(F.split(F.translate("_t", SPACES, " " * len(SPACES)), " "), ""))
    df = df.withColumn("n_words", F.size("_w").cast("bigint")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        left = F.size("_h") - step
        pairs = F.zip_with(F.slice("_h", 1, left), F.slice("_h", step + 1, left), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("_h", F.when(left > 0, pairs).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES + " ", "") != "")
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h")).withColumn("_l", lines)
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.zip_with("_h", F.sequence(F.lit(1), F.size("_h")), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    at = lambda i: F.get(F.col("_s"), i)
    twice = lambda x, i: (x.h == F.coalesce(at(i - 1).h, F.bitwise_not(x.h))) | (x.h == F.coalesce(at(i + 1).h, F.bitwise_not(x.h)))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twice), lambda x: x.p)))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a.n + WINDOW - F.greatest(F.lit(0), a.end - p)).alias("n")),
        lambda a: a.n,
    )
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_words",
        F.length(F.translate("_t", SPACES + " ", "")).cast("bigint").alias("word_chars"),
        _count(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_again"), covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        _count(F.col("_t"), "!").alias("n_bangs"),
        _count(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count(F.col("_t"), "0123456789").alias("n_digits"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals", "n_digits"]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _lgamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series seven steps up."""
    y = x + F.lit(7.0)
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def log_binomial_tail(k: Column, n: Column, p: Column, terms: int = 2000) -> Column:
    """ln P(X <= k), X binomial with n and p; 0 unless k < n p. Beyond ``terms`` terms, an upper bound for the rest."""
    k, n = k.cast("double"), n.cast("double")
    peak = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(p) + (n - k) * F.log(1 - p)
    ratio = lambda i: i / (n - i + 1) * (1 - p) / p  # noqa: E731  pmf(i - 1) / pmf(i)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        term = acc.term * ratio(k - j)
        return F.struct(term.alias("term"), (acc.total + term).alias("total"))

    def end(acc):
        rest = ratio(F.greatest(k - terms, F.lit(0.0)))
        return acc.total + acc.term * rest / (1 - rest)

    total = F.aggregate(F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int")), start, add, end)
    return F.when(k < n * p, peak + F.log(total)).otherwise(0.0)


def reject_level() -> Column:
    """The first level at which some rule rejects a document; LEVELS if none does."""


    def first(rule: str) -> Column:  # the cutoffs that a ratio passes come first
        ratio = _ratio(rule)
        return sum(((ratio <= c).cast("int") for c in RULES[rule][1]), F.lit(0))

    return F.least(*[first(rule) for rule in RULES])


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(lang, chosen, n_good, n_bad, good, bad): one row for each stratum with a proven level that is worth it.

    ``measured(doc_id, lang, base_failed, reject_level)``, ``labels(doc_id, quality)``: quality 1 is good, 0 bad, null no
    label. ``good`` and ``bad``: labelled documents that the chosen level rejects.
    """
    known = bare(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where("not base_failed").select("doc_id", "lang", "reject_level").join(known, "doc_id")
    n = lambda q, i=LEVELS: F.sum(((F.col("quality") == q) & (F.col("reject_level") <= i)).cast("bigint"))
    sums = [n(q, i).alias(f"{name}{i}") for i in range(LEVELS) for name, q in (("g", 1), ("b", 0))]
    seen = stored(held.groupBy("lang").agg(n(1).alias("n_good"), n(0).alias("n_bad"), *sums).where("n_good > 0"), "strata")  # a row for each stratum
    strata = seen.count()
    cells = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"g{i}").alias("good"), F.col(f"b{i}").alias("bad")) for i in range(LEVELS)])
    tests = seen.select("lang", "n_good", "n_bad", F.inline(cells))
    passed = log_binomial_tail(F.col("good"), F.col("n_good"), F.lit(alpha)) <= math.log(delta / max(1, strata))
    order = Window.partitionBy("lang").orderBy("level")  # LEVELS rows each
    proven = tests.withColumn("passed", passed).withColumn("proven", F.min("passed").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("proven")
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - WEIGHT * F.col("good") / F.col("n_good")
    best = proven.withColumn("gain", gain).where("bad > 0 and gain > 0")
    pick = F.max_by(F.struct(F.col("level").alias("chosen"), "n_good", "n_bad", "good", "bad"), F.struct("gain", -F.col("level")))
    out = stored(best.groupBy("lang").agg(pick.alias("x")).select("lang", "x.*"), "cutoffs")
    discard(seen)
    return out


def passes(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` with kept."""
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("chosen").alias("_chosen"))
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    joined = measured.join(chosen, measured["lang"].eqNullSafe(chosen["_lang"]), "left")
    rejected = F.coalesce(F.col("reject_level") <= F.col("_chosen"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_lang", "_chosen")


def judged(measured: DataFrame) -> DataFrame:
    return measured.withColumn("base_failed", base_failed()).withColumn("reject_level", reject_level())


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, lang, measures, base_failed, kept) of every row of ``docs(doc_id, text, lang)``."""
    narrow = judged(stored(measures(bare(docs, doc_id="bigint", text="string", lang="string")).drop("text"), "quality"))
    return passes(narrow, thresholds(narrow, labels, alpha, delta))


def keep_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Measured once: rows and measures are written and reread."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    wide = docs.select(row, F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"), F.col("`lang`").cast("string").alias("lang"))
    measured = judged(stored(measures(wide).drop("text"), "quality"))
    return passes(measured, thresholds(measured, labels, alpha, delta)).where("kept").select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    ratio = lambda sql: f"case when {sql.split(' / ')[1]} > 0 then {sql.split(' / ')[0]}::double / {sql.split(' / ')[1]} else 0 end"
    level = "least(" + ", ".join(f"len(list_filter([{', '.join(f'{c}::double' for c in cutoffs)}], lambda c: {ratio(sql)} <= c))" for sql, cutoffs in RULES.values()) + ")"
    chars = r"[\x20\x09-\x0D]"
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select rid, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select rid, i, array_to_string(ws[i:i + 7], ' ') as s from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, s) as n from g) where n >= 2),
c as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from r) group by rid),
m as (select w.rid, doc_id, lang, len(ws)::bigint as n_words, length(regexp_replace(t, '{chars}+', '', 'g'))::bigint as word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(c.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) as n_bangs,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_capitals, length(regexp_replace(t, '[^0-9]+', '', 'g')) as n_digits
      from w left join c on w.rid = c.rid),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {level} as reject_level from m),
q as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
h as (select lang, reject_level, quality from f join q on f.doc_id = q.doc_id where not base_failed),
n as (select lang, count(*) filter (quality = 1) as n_good, count(*) filter (quality = 0) as n_bad from h group by lang having count(*) filter (quality = 1) > 0),
t as (select n.lang, n_good, n_bad, level, (select count(*) from n) as strata,
             (select count(*) from h where h.lang is not distinct from n.lang and quality = 1 and reject_level <= level) as good,
             (select count(*) from h where h.lang is not distinct from n.lang and quality = 0 and reject_level <= level) as bad
      from n, range(0, {LEVELS}) as r(level)),
p as (select *, case when good < n_good * {ALPHA!r} then ln(list_sum(list_transform(range(0, good + 1),
        lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({ALPHA!r}) + (n_good - i) * ln(1 - {ALPHA!r}))))) else 0 end <= ln({DELTA!r} / strata) as passed,
        bad / greatest(n_bad, 1) - {WEIGHT!r} * good / n_good as gain from t),
s as (select *, min(passed) over (partition by lang order by level) as proven from p),
b as (select lang, arg_max(level, struct_pack(a := gain, b := -level)) as chosen from s where proven and bad > 0 and gain > 0 group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(reject_level > chosen, true) as kept
from f left join b on f.lang is not distinct from b.lang"""


ORACLE_SQL = _oracle()
