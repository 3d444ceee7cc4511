"""Operator 7: benchmark decontamination.

Words are runs without white space and ASCII punctuation, A-Z in lower case. An item is found in a document if the
best local alignment over words (Smith-Waterman: match 2, mismatch -1, gap -1) scores at least ``SHARE`` of a whole
copy's score and at least that of ``K`` words, which edited, reordered or shortened copies do as well.

Every such copy is aligned, by a filter that loses none. Seeds are all pairs of an item's words that are neighbours or
have one word between them, and the same pairs of the text. Of the steps from one match of an alignment to the next, let
g have one error at most: these are seeds, and all others cost two at least, so the score is 2 g + 2 at most. A text is
aligned with an item around the places where enough seeds for the least score stand as close as its errors allow.

The benchmark is the query set: it is held in blocks of ``ITEM_BLOCK`` items, each broadcast on its own, and each
block passes over all documents, so its size has no limit.

Items of no words match nothing; items of one or two words match only texts that consist of them. Null texts count as
empty. Repeated items are reported for each item_id, repeated rows for each row; items with a null id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, batches_of, read, stored, text_buffers
from .words import PUNCTUATION, STEP, U, mix, words

K, SHARE = 3, 0.4
ITEM_BLOCK = 20_000
MOST_PLACES = 1 << 22  # seeds of items at places of texts that are looked at together, unless one text has more
MATCH, MISMATCH, GAP = 2, -1, -1


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end of its alignment in the text) for two arrays of word hashes."""
    n = len(text)
    steps = -GAP * np.arange(n + 1)
    above = np.zeros(n + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above + GAP, 0)
        np.maximum(row[1:], above[:-1] + np.where(text == w, MATCH, MISMATCH), out=row[1:])
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the text
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def least_score(lengths, share: float):
    """Score from which an item of so many words counts as found."""
    return np.maximum(share * MATCH * lengths, MATCH * K)


def _windows(places: np.ndarray, offsets: np.ndarray, length: int, n: int, slack: int) -> list[tuple[int, int]]:
    """Parts of a text of n words that may hold an item, around seeds at ``places`` (``offsets`` within the item).

    ``slack``: gaps that an alignment may have.
    """
    starts = np.maximum(places - offsets - slack, 0)
    ends = np.minimum(places - offsets + length + slack, n)
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order], ends[order], strict=True):
        if out and a <= out[-1][1] and b - out[-1][0] <= 4 * length + 64:
            out[-1][1] = max(out[-1][1], int(b))
        else:
            out.append([int(a), int(b)])
    return [(a, b) for a, b in out]


def _pairs(h: np.ndarray, bounds: np.ndarray):
    """(hash, row, place of its first word) of each pair of a row's words with one word between them at most."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for step in (1, 2):
        first = np.flatnonzero(row[:-step] == row[step:])
        found.append((mix(h[first] * STEP[0] + h[first + step] * STEP[1]), row[first], first - bounds[row[first]]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


class Items:
    """A block of the benchmark: word hashes and seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        data = [(t or "").encode("utf-8") for _, t in rows]
        off = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        row, _, _, h = words(raw, off, between=PUNCTUATION)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        self.words = [h[cuts[i] : cuts[i + 1]] for i in range(len(rows))]
        self.lengths = np.diff(cuts)
        seeds, item, place = _pairs(h, cuts)
        order = np.flatnonzero(self.lengths[item] >= K)
        order = order[np.argsort(seeds[order], kind="stable")]
        self.seeds, self.item, self.place = seeds[order], item[order], place[order]
        self.short: dict[tuple[int, ...], list[int]] = {}
        for i in np.flatnonzero((self.lengths > 0) & (self.lengths < K)).tolist():
            self.short.setdefault(tuple(self.words[i].tolist()), []).append(i)


def _sieve(seeds: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, dtype=bool)
    table[(seeds & U((1 << 20) - 1)).astype(np.int64)] = True
    return table


def _hits(hashes: np.ndarray, seeds: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Indexes of ``hashes`` that are seeds."""
    maybe = np.flatnonzero(sieve[(hashes & U((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(seeds, hashes[maybe])
    at[at == len(seeds)] = 0
    return maybe[seeds[at] == hashes[maybe]]


def _paired(batch: pa.RecordBatch):
    """Per chunk of rows: first row, word hashes, their bounds."""
    raw, off = text_buffers(batch.column(1))
    for i, j in batches_of(off):
        row, _, _, h = words(raw[off[i] : off[j]], off[i : j + 1] - off[i], between=PUNCTUATION)
        yield i, h, np.searchsorted(row, np.arange(j - i + 1))


def _places(items: Items, sieve: np.ndarray, h: np.ndarray, cuts: np.ndarray, share: float):
    """Arrays (row, item, place in the text, place in the item) of the seeds that may belong to a found copy, sorted."""
    hashes, rows, starts = _pairs(h, cuts)
    hit = _hits(hashes, items.seeds, sieve)
    hit = hit[np.argsort(rows[hit], kind="stable")]
    low, high = np.searchsorted(items.seeds, hashes[hit]), np.searchsorted(items.seeds, hashes[hit], side="right")
    ends = np.cumsum(high - low)
    least = least_score(items.lengths, share)
    need = np.ceil(least / MATCH - 1 - 1e-9).astype(np.int64)
    span = np.floor((1 + MATCH) * items.lengths - least).astype(np.int64)
    a = 0
    while a < len(hit):  # whole texts
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_PLACES)), a + 1)
        b = int(np.searchsorted(rows[hit], rows[hit[b - 1]], side="right")) if b < len(hit) else len(hit)
        times = high[a:b] - low[a:b]
        which = np.repeat(low[a:b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, where = np.repeat(rows[hit[a:b]], times), np.repeat(starts[hit[a:b]], times)
        item, offset = items.item[which], items.place[which]
        order = np.lexsort((where, item, row))
        row, item, where, offset = row[order], item[order], where[order], offset[order]
        fresh = np.ones(len(row), dtype=bool)  # a place counts once
        fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1])
        at, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        last = np.arange(len(at)) + need[item[at]] - 1
        to = at[np.minimum(last, len(at) - 1)]
        full = np.flatnonzero((last < len(at)) & (row[to] == row[at]) & (item[to] == item[at]) & (where[to] - where[at] <= span[item[at]]))
        change = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(change, full, 1)
        np.add.at(change, last[full] + 1, -1)
        stay = np.cumsum(change)[number] > 0
        yield row[stay], item[stay], where[stay], offset[stay]
        a = b


def _aligned(docs: DataFrame, items: Items, share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        items = shared.value
        sieve = _sieve(items.seeds)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for i, h, cuts in _paired(batch):
                if items.short:
                    for r in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < K)).tolist():
                        out += [(doc_ids[i + r], items.ids[m], 1.0, int(items.lengths[m])) for m in items.short.get(tuple(h[cuts[r] : cuts[r + 1]].tolist()), [])]
                for row, item, where, offsets in _places(items, sieve, h, cuts, share):
                    turn = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))) if len(row) else []
                    for a, b in zip(turn, [*turn[1:], len(row)], strict=False):
                        r, m = int(row[a]), int(item[a])
                        text, query = h[cuts[r] : cuts[r + 1]], items.words[m]
                        best, least = (0, 0), least_score(len(query), share)
                        for x, y in _windows(where[a:b], offsets[a:b], len(query), len(text), int(MATCH * len(query) - least)):
                            score, end = smith_waterman(query, text[x:y])
                            best = max(best, (score, x + end))
                        if best[0] >= least:
                            out.append((doc_ids[i + r], items.ids[m], best[0] / (MATCH * len(query)), best[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64())],
                names=["doc_id", "item_id", "score", "end_word"],
            )

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, score double, end_word bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, score, end_word): items found in ``docs(doc_id, text)``, end_word the words up to the copy's end."""
    own = bare(docs, doc_id="bigint", text="string")
    numbered = bare(benchmark, item_id="bigint", text="string").where("item_id is not null")
    out, block = None, []

    def add(block):
        found = _aligned(own, Items(block), share)
        return found if out is None else out.unionAll(found)

    for row in numbered.orderBy("item_id", "text").toLocalIterator():  # the query set, a partition at a time
        block.append((row[0], row[1]))
        if len(block) == item_block:
            out, block = add(block), []
    return add(block) if block or out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns; rows with a null doc_id stay."""
    found = stored(contaminated(docs, benchmark, share).select(F.col("doc_id").alias("__found")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col("__found"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
