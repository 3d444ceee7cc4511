"""Operator 8: token counts under a unigram model, by dynamic programming shared over a trie.

The model gives each vocabulary piece a log-probability; a pre-token's tokens are its most probable split into pieces
(fewest tokens among equals). The best score of a prefix depends on the prefix alone, so the distinct pre-tokens go
into a trie whose nodes hold (score, tokens) of the best split of their prefix: each node is computed once, from its
own ancestors, however many pre-tokens pass through it. Terminal nodes give the counts.

Pieces come from a public rank file; their scores follow the rank by Zipf's law, log p = -log(rank + 2) up to the
constant of normalisation, since the file has ranks and no frequencies. Every byte is a piece, so each text has a split.

Distinct pre-tokens recur within and across the texts of a task: each task keeps one trie and empties it at ``NODES``
nodes. Pre-tokens of more than ``LONG`` bytes, which hardly share prefixes, run through the same recurrence outside the
trie, holding only the scores that a piece can still reach. Both bound memory and change no result.

Null and empty texts have 0 tokens, an empty table no rows; repeated rows and null ids are counted row by row; splits of
equal probability count the fewest tokens; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import _codec_source, ranks_of
from .common import bare, read, texts

#: Trie nodes that a task keeps, and bytes of the longest pre-token that enters it.
NODES, LONG = 400_000, 2048


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    norm = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {piece: -math.log(r + 2) - norm for piece, r in ranks.items()}


#: A piece's score as a whole number: billionths of its log-probability times SHIFT, less one. So a greater sum is a
#: more probable split, and among equals the one of fewer tokens, whose number stands in the sum's last digits.
SHIFT = 1 << 32


class TrieCounter(dict):
    """Tokens by pre-token: best splits of prefixes, one node for each distinct prefix of the inserted pre-tokens."""

    def __init__(self, scores: dict[bytes, float], most: int = NODES, long: int = LONG):
        self.most, self.long = most, long
        self.computed = 0  # nodes whose score was computed, for tests
        # each piece's score, and None for bytes that only end a piece: what is in neither ends no piece, nor does more
        self.pieces: dict[bytes, int | None] = {}
        self.reach = max(map(len, scores))
        for piece, score in scores.items():
            self.pieces[piece] = round(score * 1e9) * SHIFT - 1
            for i in range(1, len(piece)):
                self.pieces.setdefault(piece[i:], None)
        self.reset()

    def reset(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.best: list[int] = [0]
        self.clear()

    def _top(self, token: bytes, end: int, values, first: int = 0) -> int:
        """Score of the best split of a prefix, whose own prefixes from ``first`` on have ``values``."""
        pieces, top = self.pieces, None
        for start in range(end - 1, -1, -1):
            score = pieces.get(token[start:end], 0)
            if score == 0:
                break
            if score is not None:
                total = values[start - first] + score
                if top is None or total > top:
                    top = total
        return top

    def insert(self, token: bytes) -> int:
        """Tokens of a pre-token; new nodes are computed on the way down, each from its own prefixes."""
        nexts, best = self.next, self.best
        children, values, end = nexts[0], [0], 0
        for byte in token:
            end += 1
            child = children.get(byte)
            if child is None:
                child = children[byte] = len(nexts)
                nexts.append({})
                best.append(self._top(token, end, values))
                self.computed += 1
            children = nexts[child]
            values.append(best[child])
        return -values[-1] % SHIFT

    def pass_through(self, token: bytes) -> int:
        """The same without the trie, in memory that doesn't grow with the pre-token."""
        values, first = [0], 0
        for end in range(1, len(token) + 1):
            values.append(self._top(token, end, values, first))
            if len(values) > 4 * self.reach:
                drop = len(values) - self.reach
                del values[:drop]
                first += drop
        return -values[-1] % SHIFT

    def __missing__(self, token: str) -> int:
        raw = token.encode("utf-8")
        if len(raw) > self.long:
            return self.pass_through(raw)
        if len(self.next) > self.most:
            self.reset()
        n = self[token] = self.insert(raw)
        return n


_counters: dict[int, TrieCounter] = {}


def token_counts(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row of ``docs(doc_id, text)``."""
    content, pattern = _codec_source(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        import regex

        key = hash(content.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = TrieCounter(zipf_scores(ranks_of(content.value)))
        counter, split = _counters[key], regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cells, tokens = [], []
                for text in texts(part.column(1)):
                    found = split.findall(text)
                    cells.append(len(found))
                    tokens.append(sum(map(counter.__getitem__, found)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(cells, dtype=np.int64)), pa.array(np.array(tokens, dtype=np.int64))], names=["doc_id", "n_pretokens", "n_tokens"])

    return bare(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
