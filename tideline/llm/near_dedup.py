"""Operator 3: near duplicates by b-bit MinHash.

A document's set are the distinct k-word shingles of its text, A-Z in lower case (fewer than k words: the whole
sequence as one; no words: empty, linked with nothing). Documents are linked where 100 * intersection >= percent *
union, and the links' connected components are the groups.

1. One pass over whole texts: set size, a 128-bit digest of the set, ``PERMUTATIONS`` minima, of which the low
   ``BITS`` bits are kept and packed, and band keys of ``ROWS`` full minima each. Documents with equal digests
   are one class; all that follows works on classes, so copies never meet in pairs.
2. Classes that share a band key form a bucket. Each bucket's hub is its member with the most company over all bands
   (in a family of edited copies, the original). Only (hub, member) pairs are formed: as many as band rows.
3. The similarity of a pair is estimated from the packed signatures: share of equal b-bit groups, by bit counts,
   corrected for chance collisions of 2**-BITS. Pairs below the threshold by more than ``SIGMAS`` standard deviations
   are dropped; the rest is confirmed on full sets. Links give first components.
4. In buckets that still hold several components, the other members are compared in blocks of ``BLOCK`` rows: blocks
   of one and the same component are skipped, all others meet pairwise, first by signature and then, where that leaves
   a chance, on full sets. A task holds two blocks at most (a member of a large set counts as many, so that blocks are
   bounded in bytes as well) and returns a spanning forest of the links it finds, never the pairs. So no link between candidates is lost and nothing is capped, while a family of n copies costs about n.
5. Links of both steps give the components.

There are as many bands as make the probability that a pair at the threshold shares none at most ``MISSED``: 27 bands
of 4 rows at 0.8, 19 at 0.85. Texts move once to meet the classes whose full sets are asked for, whatever their number.

Shingles are 64-bit hashes, so "full sets" are exact but for chance collisions of about n**2 / 2**64 in a pair's n
shingles. Rows with a null doc_id are linked with nothing and kept; rows that repeat a doc_id are compared like others,
each with its own text's component; null and empty texts are linked with nothing; ties (equal sets) are one class; very
long texts are hashed whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, batches_of, discard, read, stored, text_buffers
from .components import components
from .words import STEP, U, mix, shingle_hashes, words

PERMUTATIONS, BITS, ROWS = 256, 4, 4
#: Most that a link at the threshold may be missed with, which sets the number of bands.
MISSED = 1e-6
SIGMAS, BLOCK = 5.0, 512
#: Shingles of a member that counts once in its block.
WEIGHT = 2048

_rng = np.random.RandomState(6502)
_MUL = _rng.randint(0, 2**31, (PERMUTATIONS, 1), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.randint(0, 2**32, (PERMUTATIONS, 1), dtype=np.int64).astype(np.uint32)
_BAND = mix(np.arange(1, PERMUTATIONS // ROWS + 1, dtype=U) * STEP[60])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of 64-bit hashes."""
    x = (shingles >> U(32)).astype(np.uint32)[None, :]
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.shape[1], 1024):
        np.minimum(out, (_MUL * x[:, at : at + 1024] + _ADD).min(axis=1), out=out)
    return out


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits of each minimum, mixed so that they depend on the whole value, two to a byte."""
    v = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (v[0::2] | (v[1::2] << np.uint8(BITS))).tobytes()


def bands_for(percent: int) -> int:
    """Bands with which two sets at the threshold share no band with probability MISSED at most."""
    return min(PERMUTATIONS // ROWS, math.ceil(math.log(MISSED) / math.log(1 - min(0.999, percent / 100) ** ROWS)))


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = least[: bands * ROWS].reshape(bands, ROWS).astype(U)
    return mix((rows * STEP[:ROWS]).sum(axis=1, dtype=U) + _BAND[:bands]).view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures; uint8 arrays whose last axis is a signature."""
    x = (a ^ b).view(U)
    x = x | (x >> U(1))
    x = (x | (x >> U(2))) & U(0x1111111111111111)  # one bit for each group that differs
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / PERMUTATIONS
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    j, chance = percent / 100, 2.0**-BITS
    m = j + (1 - j) * chance
    return j - SIGMAS * (m * (1 - m) / PERMUTATIONS) ** 0.5 / (1 - chance)


def is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of sorted arrays of distinct shingles."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(raw: np.ndarray, off: np.ndarray, k: int):
    """(row, sorted distinct shingles) of every row."""
    for i, j in batches_of(off, 1 << 19):
        row, _, _, h = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        hashes, bounds = shingle_hashes(row, h, k, j - i)
        for r in range(j - i):
            yield i + r, np.unique(hashes[bounds[r] : bounds[r + 1]])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, k: int, n_bands: int) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, bands) of every row of ``docs(doc_id, text)``; cls is null for an empty set."""

    def run(batches):
        known: dict[bytes, tuple[bytes, np.ndarray]] = {}  # signatures of classes met shortly before
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            cls, sig, bands = [], [], []
            for r, s in _sets(raw, off, k):
                sizes[r] = len(s)
                if len(s):
                    key = _digest(s)
                    if key not in known:
                        if len(known) > 5_000:
                            known.clear()
                        m = minima(s)
                        known[key] = packed(m), band_keys(m, n_bands)
                    got = known[key]
                    cls.append(key)
                    sig.append(got[0])
                    bands.append(got[1])
                else:
                    cls.append(None)
                    sig.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "cls", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, cls binary, sig binary, bands array<bigint>")


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(cls, s) for ``needed(doc_id, cls)``, one document of each class: its sorted shingles as bytes."""

    def run(batches):
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            want, cls, sets = batch.column(2).to_pylist(), [], []
            for r, s in _sets(raw, off, k):
                if len(s) and _digest(s) == want[r]:  # another row of the same doc_id has another set
                    cls.append(want[r])
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "s"])

    return docs.join(needed, "doc_id").select("doc_id", "text", "cls").mapInArrow(run, "cls binary, s binary").dropDuplicates(["cls"])


def _hub_pairs(buckets: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """(hub, cls): distinct pairs of a bucket's hub and its members whose estimate leaves a chance."""
    pairs = buckets.where("cls <> hub").select("hub", "cls").distinct()
    both = pairs.join(signatures, "cls").join(signatures.select(F.col("cls").alias("hub"), F.col("sig").alias("hub_sig")), "hub")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                yield batch.filter(pa.array(estimated(a, b) >= least)).select([0, 1])

    return both.select("hub", "cls", "sig", "hub_sig").mapInArrow(run, "hub binary, cls binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that are links on full sets."""
    both = pairs.join(sets, "cls").join(sets.select(F.col("cls").alias("hub"), F.col("s").alias("hub_s")), "hub")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
                yield part.filter(pa.array([is_link(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(a, b, strict=True)], pa.bool_())).select([0, 1])

    return both.select("hub", "cls", "s", "hub_s").mapInArrow(run, "hub binary, cls binary").select(F.col("hub").alias("a"), F.col("cls").alias("b"))


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Deals the members of each bucket to pairs of blocks: (key, x, y, side, comp, *columns), sorted by (key, x, y).

    A component of BLOCK members or more has blocks of its own, by the members' hashes; the bucket's other components
    share blocks, each whole in one. Blocks hold some BLOCK members. Two blocks of one same component don't meet.
    """
    sizes = rows.groupBy("key", "comp").agg(F.sum("weight").alias("n"))
    rest = sizes.where(F.col("n") < BLOCK).groupBy("key").agg(F.sum("n").alias("m"))
    dealt = sizes.join(rest, "key", "left").select("key", "comp", (F.col("n") >= BLOCK).alias("_own"), F.ceil(F.when(F.col("n") >= BLOCK, F.col("n")).otherwise(F.col("m")) / BLOCK).alias("_parts"))
    own = F.xxhash64("comp", F.pmod(F.xxhash64("cls"), "_parts"))
    numbered = rows.join(dealt, ["key", "comp"]).withColumn("block", F.when(F.col("_own"), own).otherwise(F.pmod(F.xxhash64("comp"), "_parts")))
    spans = numbered.groupBy("key", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    other = spans.select("key", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = spans.join(other, "key").where("block <= other and not (low = high and low2 = high2 and low = low2)")
    sides = meet.select("key", F.inline(F.array(*[F.struct(F.col(c).alias("block"), F.col("block").alias("x"), F.col("other").alias("y"), F.lit(s).alias("side")) for c, s in (("block", 0), ("other", 1))])))
    sides = sides.where("not (side = 1 and x = y)")
    dealt = numbered.join(sides, ["key", "block"]).select("key", "x", "y", "side", "comp", *columns)
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")


def _runs(batches, width: int):
    """Rows of equal (key, x, y) together, as lists of columns; the input is sorted by them."""
    held: list[list] = []
    last = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:3] != last:
                if held:
                    yield list(zip(*held, strict=True))
                held, last = [], row[:3]
            held.append(row)
    if held:
        yield list(zip(*held, strict=True))


def _chances(run: list, sig: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of a run's rows lie in different components (and blocks, if there are two) with a high estimate."""
    comp = np.unique(np.array(run[4], dtype=object), return_inverse=True)[1]
    side = np.array(run[3])
    ok = np.zeros((len(sig), len(sig)), dtype=bool)
    for i in range(len(sig) - 1):
        ok[i, i + 1 :] = (estimated(sig[i], sig[i + 1 :]) >= least) & (comp[i] != comp[i + 1 :])
    if side.any():
        ok &= side[:, None] != side[None, :]
    return ok


def _open_members(rows: DataFrame, least: float) -> DataFrame:
    """(key, cls): members of ``rows(key, comp, cls, sig, weight)`` that may be linked to another component of the bucket."""

    def run(batches):
        for r in _runs(batches, 7):
            ok = _chances(r, np.frombuffer(b"".join(r[6]), np.uint8).reshape(len(r[6]), -1), least)
            hit = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array([r[0][i] for i in hit], pa.int64()), pa.array([r[5][i] for i in hit], pa.binary())], names=["key", "cls"])

    return _blocks(rows, ["cls", "sig"]).mapInArrow(run, "key bigint, cls binary").distinct()


def _block_links(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b): links between components within buckets of ``rows(key, comp, cls, sig, weight, s)``, a forest for each task's run."""

    def run(batches):
        for r in _runs(batches, 8):
            sig = np.frombuffer(b"".join(r[6]), np.uint8).reshape(len(r[6]), -1)
            ok = _chances(r, sig, least)
            root = list(np.unique(np.array(r[4], dtype=object), return_inverse=True)[1])  # components so far
            parent = list(range(max(root) + 1))

            def find(x):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            sets = [np.frombuffer(s, U) for s in r[7]]
            a, b = [], []
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = find(root[i]), find(root[j])
                if x != y and is_link(sets[i], sets[j], percent):
                    parent[x] = y
                    a.append(r[5][i])
                    b.append(r[5][j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return _blocks(rows, ["cls", "sig", "s"]).mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cls, component) of every row of ``docs(doc_id, text)``.

    cls is what ``class_of`` gives, component names the group itself: where doc_ids repeat, two groups can have the same
    least doc_id.
    """
    least = least_estimate(percent)
    own = bare(docs, doc_id="bigint", text="string")
    seen = stored(features(own, k, bands_for(percent)), "minhash")
    classes = stored(seen.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "classes")

    # buckets of two or more, their hubs
    rows = classes.select("cls", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(rows.join(sizes, "key"), "buckets")
    company = members.groupBy("cls").agg(F.sum("n").alias("company"))
    ranked = members.join(company, "cls")
    hubs = ranked.groupBy("key").agg(F.max_by("cls", F.struct("company", "cls")).alias("hub"))
    buckets = stored(members.join(hubs, "key"), "buckets")

    signatures = classes.select("cls", "sig")
    pairs = stored(_hub_pairs(buckets, signatures, least), "pairs")
    involved = pairs.select("cls").union(pairs.select(F.col("hub").alias("cls"))).distinct()
    known = _sets_of(own, classes, involved, k, "merge")
    links = stored(_confirmed(pairs, known, percent), "links")
    first = components(links)

    # buckets of three or more with several components: members other than the hub
    left = buckets.where("n > 2 and cls <> hub").join(first.select(F.col("node").alias("cls"), "component"), "cls", "left")
    left = left.select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    weight = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / WEIGHT)).cast("bigint")
    mixed = left.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = stored(left.join(mixed, "key").join(classes.select("cls", "sig", weight.alias("weight")), "cls"), "left")
    open_ = stored(_open_members(left, least), "open")
    narrowed = left.join(open_, ["key", "cls"])
    fresh = _sets_of(own, classes, open_.select("cls").distinct().join(known, "cls", "left_anti"), k)
    sets = known.unionByName(fresh)
    more = _block_links(narrowed.join(sets, "cls"), least, percent)
    every = stored(links.unionByName(more), "links")
    final = components(every)
    out = labelled(seen, classes, final)
    discard(members, buckets, pairs, links, first, left, open_, known, fresh, every, final, classes)
    return out


def _sets_of(docs: DataFrame, classes: DataFrame, needed: DataFrame, k: int, hint: str | None = None) -> DataFrame:
    wanted = stored(classes.join(needed, "cls").select("doc_id", "cls"), "needed")
    out = stored(full_sets(docs, wanted.hint(hint) if hint else wanted, k), "sets")
    discard(wanted)
    return out


def labelled(seen: DataFrame, classes: DataFrame, final: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cls, component) from the classes' components."""
    of = classes.join(final.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = stored(of.join(least, "component").select("cls", "component_id", "component"), "component-ids")
    joined = seen.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"), "cls", ids["component"])


def class_of(text: Column, k: int = 5) -> Column:
    """The digest of a text's shingle set; null if it is empty."""

    @F.pandas_udf("binary")
    def digest(column: pd.Series) -> pd.Series:
        raw, off = text_buffers(pa.Array.from_pandas(column, type=pa.large_string()))
        return pd.Series([_digest(s) if len(s) else None for _, s in _sets(raw, off, k)], dtype=object)

    return digest(text)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85).drop("cls", "component")


#: All pairs that share a shingle, and the closure of their links: for small tables.
ORACLE_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, sh from (
        select doc_id, array_to_string(ws[i:i + 2], ' ') as sh from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)
        union all select doc_id, array_to_string(ws, ' ') from w where len(ws) in (1, 2))),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
g as (select a, b from e union all select b, a from e),
r(doc_id, component) as (select doc_id, doc_id from w union select g.b, r.component from r join g on g.a = r.doc_id),
l as (select doc_id, min(component) as component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept from w join l on w.doc_id = l.doc_id left join n on n.doc_id = w.doc_id"""
