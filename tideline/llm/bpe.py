"""Operator 2: byte-level BPE encoding and decoding by a monoid tree reduction.

A text's encoding is an element of a monoid: (tokens of a span of bytes). Spans of up to ``LEAF`` characters are
encoded at once; a longer text is halved recursively and the two encodings are joined. A join re-encodes a window of
tokens around the boundary, which doubles on either side until the tokens outside provably stay as they are. A window
edge is proven in one of two ways:

* the split pattern always cuts there, whatever stands around it: a character that is no white space before white
  space, an ASCII letter before an ASCII character that is no letter, or an ASCII digit before an ASCII character
  that is no digit. No match of the pattern spans such a place and no alternative looks behind, so each side's
  tokens depend on that side alone;
* both neighbours are letters (or both digits), so that the pattern cannot cut there, and the token pair across the
  edge encodes to itself. A sequence of tokens in one match whose neighbouring pairs all do so is that match's only
  encoding by ranked merges.

Decoding concatenates the tokens' bytes up the same tree. Null texts count as empty; an empty text has no tokens and
the hashes of empty input. Every row of the input gives one row, repeated rows and null ids included, an empty table
none; other columns are ignored, whatever their names. Texts are encoded whole, however long; pairs of equal rank merge
from the left.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bare, read, texts

#: Characters that are encoded at once.
LEAF = 512
#: Tokens on either side of a boundary in the first window.
WINDOW = 8

_OLD = unicodedata.ucd_3_2_0  # classes that no later version of Unicode changes


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def _space(c: str) -> bool:
    return c in " \t\n\x0b\x0c\r"


def _kind(c: str) -> str:
    """L or N where the class is certain in every version of Unicode, else empty."""
    k = _OLD.category(c)[0]
    return k if k in "LN" else ""


def always_cut(left: str, right: str) -> bool:
    """Whether the split pattern has a boundary between two such characters in every context."""
    if _space(right):
        return 0x21 <= ord(left) < 0x7F or bool(_kind(left))
    if ord(left) < 128 and ord(right) < 128:
        return (left.isalpha() and not right.isalpha()) or (left.isdigit() and not right.isdigit())
    return False


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.leaf, self.window = max(1, leaf), max(1, window)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = {v: k for k, v in ranks.items()}

    # -- encoding -----------------------------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text)) if text else []

    def _span(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.core.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self.join(self._span(text, a, m), self._span(text, m, b))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the two spans' concatenation."""
        if not left or not right:
            return left or right
        i = j = self.window
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            head, tail = left[: len(left) - i], right[j:]
            window = self._text(left[len(left) - i :], right[:j])
            ok_head = ok_tail = False
            if window is not None:
                middle = self.core.encode_ordinary(window)
                ok_head = not head or self._stable(head, middle, -1, 0)
                ok_tail = not tail or self._stable(middle, tail, -1, 0)
                if ok_head and ok_tail:
                    return head + middle + tail
            if not ok_head:
                i *= 2
            if not ok_tail:
                j *= 2

    def _text(self, *runs: list[int]) -> str | None:
        try:
            return b"".join(self.piece[t] for run in runs for t in run).decode("utf-8")
        except UnicodeDecodeError:  # an edge inside a character
            return None

    def _edge(self, run: list[int], at_end: bool) -> str | None:
        """The character at a run's end or start, if its bytes are whole."""
        got = b""
        for t in reversed(run[-4:]) if at_end else run[:4]:
            got = self.piece[t] + got if at_end else got + self.piece[t]
            for n in range(1, 5):
                part = got[-n:] if at_end else got[:n]
                if len(part) == n:
                    try:
                        c = part.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        return c
        return None

    def _stable(self, left: list[int], right: list[int], a: int, b: int) -> bool:
        c, d = self._edge(left, True), self._edge(right, False)
        if c is None or d is None:
            return False
        if always_cut(c, d):
            return True
        if not (_kind(c) and _kind(c) == _kind(d)):
            return False
        pair = self.piece[left[a]] + self.piece[right[b]]
        try:
            text = pair.decode("utf-8")
        except UnicodeDecodeError:
            return False
        inner = text[1:] if text[0] == " " else text
        return all(_kind(x) == _kind(c) for x in inner) and self.core.encode_ordinary(text) == [left[a], right[b]]

    # -- decoding -----------------------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: short runs at once, longer ones as the concatenation of their halves."""
        if len(ids) <= self.leaf:
            return b"".join([self.piece[t] for t in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


def _codec_source(spark: SparkSession, ranks_path: str | None, pattern: str | None):
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read()  # under 1 MB: a vocabulary's size doesn't depend on the corpus
    return spark.sparkContext.broadcast(content), pattern or public_tokenizers.PATTERN


_codecs: dict[int, Codec] = {}


def _codec(content, pattern: str) -> Codec:
    key = hash((content.value, pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_of(content.value), pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs(doc_id, text)``.

    Without ``with_ids``, the ids are null and only the digests leave the workers.
    """
    content, pattern = _codec_source(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        codec = _codec(content, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts, hashes, decoded = [], [], [], []
                for text in texts(part.column(1)):
                    got = codec.encode(text)
                    ids.append(got if with_ids else None)
                    counts.append(len(got))
                    hashes.append(hashlib.sha256(np.asarray(got, dtype="<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(got)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return bare(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def bpe_decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, text) from ``encoded(doc_id, ids)``; null ids count as empty, bytes that are no UTF-8 are replaced."""
    content, pattern = _codec_source(encoded.sparkSession, ranks_path, None)

    def run(batches):
        codec = _codec(content, pattern)
        for batch in batches:
            out = [codec.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return bare(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
