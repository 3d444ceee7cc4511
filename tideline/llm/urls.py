"""Operator 10: URL filters: rule lists, and gradient-boosted trees on lexical features where no rule fits.

Host, path, rules and features are columns. The trees are trained from labelled URLs: by default each row has the label
of its rule, and a row that no rule names counts as allowed with the weight ``UNLISTED``, since lists name what to
block and leave out what is fine (trained on the listed alone, a suffix with nothing but block rules would lose all of
its other URLs). At most ``SAMPLE`` distinct URLs train the model, on the driver: of each
class (block, allow, unlisted) an equal part, those with the smallest hashes, weighted to all rows of the class. Its trees then become one column expression that scores all rows inside the JVM. The suffix statistics (share of all rows under an address suffix, hosts per row in it) come from grouped
aggregation over all rows and hold no labels, which they would leak into what they help to predict.

A null or empty URL, or one without ``://``, has an empty host and path, no rule, and the verdict of the model on it.
Without labels of both classes the model allows everything; a probability of just one half blocks; rules of equal length
can't both fit. Every row gives one row, repeated rows and null ids included, an empty table none; URLs are read whole,
however long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, discard, read, stored

#: Labelled rows that train the model at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 30, 3, 0.2, 32, 20
UNLISTED = 0.5
#: Suffixes that are joined as a broadcast at most; beyond, the join shuffles.
BROADCAST_SUFFIXES = 10_000

# The contract's rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "suffix_share", "suffix_hosts"]


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls(_url)`` with host, path, rule and the rule's verdict. ``rules``: a short list, compiled into the plan."""
    host, path = split_url(F.col("_url"))
    df = urls.withColumn("_url", F.coalesce("_url", F.lit(""))).withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tried first
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("_ruled", verdict)


def with_features(urls: DataFrame) -> DataFrame:
    url, host, path = F.col("_url"), F.col("host"), F.col("path")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    df = (
        urls.withColumn("suffix", F.substring_index("host", ".", -1))
        .withColumn("length", F.length(url))
        .withColumn("host_length", F.length(host))
        .withColumn("path_length", F.length(path))
        .withColumn("depth", count(path, "/"))
        .withColumn("labels", count(host, ".") + 1)
        .withColumn("digit_ratio", count(url, "0123456789") / n)
        .withColumn("hyphens", count(host, "-"))
        .withColumn("entropy", F.round(entropy, 6))
        .withColumn("parameters", F.when(F.locate("?", url) > 0, count(url, "&") + 1).otherwise(0))
    )
    hosts = df.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")), "suffixes")
    total = counts.agg(F.sum("n")).first()[0] or 1
    stats = counts.select("suffix", (F.col("n") / F.lit(total)).alias("suffix_share"), (F.col("hosts") / F.col("n")).alias("suffix_hosts"))
    if stats.count() <= BROADCAST_SUFFIXES:
        stats = F.broadcast(stats)
    return df.join(stats, "suffix", "left")


# -- boosted trees ---------------------------------------------------------------------------------------------------
def _tree(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(-g / (h + 1.0)) * RATE
    if depth == 0 or len(rows) < 2 * LEAST:
        return leaf
    best = (1e-6, None)
    for f in range(binned.shape[1]):
        if not len(edges[f]):
            continue
        b = binned[rows, f]
        size = len(edges[f]) + 1
        gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), (f, k))
    if best[1] is None:
        return leaf
    f, k = best[1]
    low = binned[rows, f] <= k
    return (f, float(edges[f][k]), _tree(binned, edges, grad, hess, rows[low], depth - 1), _tree(binned, edges, grad, hess, rows[~low], depth - 1))


def _score(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _score(low, x), _score(high, x))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list]:
    """Logistic gradient boosting over quantile bins: (start, trees). A tree: a leaf or (feature, cut, at most, above)."""
    if len(y) == 0 or y.min() == y.max():
        return (-10.0 if len(y) == 0 or y[0] == 0 else 10.0), []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T, strict=True)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    weight = np.ones(len(y)) if weight is None else weight
    share = float((y * weight).sum() / weight.sum())
    start = float(np.log(share / (1 - share)))
    margin, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(binned, edges, (p - y) * weight, p * (1 - p) * weight, np.arange(len(y)), depth)
        out.append(tree)
        margin = margin + _score(tree, x)
    return start, out


def as_column(model: tuple[float, list]) -> Column:
    def build(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, low, high = tree
        return F.when(F.col(FEATURES[f]) <= cut, build(low)).otherwise(build(high))

    total = F.lit(model[0])
    for tree in model[1]:
        total = total + build(tree)
    return total


def url_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every row of ``pages(page_id, url)``.

    ``labels(page_id, blocked 0/1)``: other labels than the rules' own verdicts to train from.
    """
    df = with_features(with_rules(bare(pages, page_id="bigint", url="string").withColumnRenamed("url", "_url"), rules))
    if labels is None:
        known = df.withColumn("_y", F.coalesce((F.col("_ruled") == "block").cast("int"), F.lit(0))).withColumn("_weight", F.when(F.col("_ruled").isNull(), UNLISTED).otherwise(1.0))
    else:
        known = df.join(bare(labels, page_id="bigint", blocked="int").where("blocked is not null").dropDuplicates(["page_id"]).withColumnRenamed("blocked", "_y"), "page_id").withColumn("_weight", F.lit(1.0))
    kinds = [F.col("_y") == 1, (F.col("_y") == 0) & (F.col("_weight") == 1), F.col("_weight") != 1]  # block, allow, unlisted
    urls = known.withColumn("_kind", F.when(kinds[0], 0).when(kinds[1], 1).otherwise(2)).groupBy("_url", "_kind").agg(F.count(F.lit(1)).alias("_n"), *[F.first(F.col(c).cast("double")).alias(c) for c in FEATURES], F.first("_y").alias("_y"), F.first("_weight").alias("_weight"))
    urls = stored(urls, "urls")
    full, table = {k: n for k, n in urls.groupBy("_kind").agg(F.sum("_n")).collect()}, np.zeros((0, len(FEATURES) + 2))
    for kind in sorted(full):  # at most ``sample`` rows; each class weighs what all its rows do
        rows = urls.where(F.col("_kind") == kind).orderBy(F.xxhash64("_url"), "_url").limit(max(1, sample // len(full))).select(*FEATURES, "_y", "_weight", "_n").collect()
        part = np.array([tuple(r) for r in rows], dtype=float)
        part[:, -2] *= part[:, -1] * full[kind] / part[:, -1].sum()
        table = np.concatenate([table, part[:, :-1]])
    discard(urls)
    table[:, -1] *= min(1.0, sample / max(1, sum(full.values())))
    margin = as_column(train(table[:, :-2], table[:, -2], table[:, -1]))
    judged = df.withColumn("p_block", 1 / (1 + F.exp(-margin)))
    verdict = F.coalesce("_ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("p_block", 6).alias("p_block"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
