"""Operator 4: secret scans.

Three steps over the UTF-8 bytes of a text: an Aho-Corasick automaton finds the keywords of all kinds in one pass; only
where a keyword stands is the kind's regular expression tried, anchored at that place; a match of a kind with an
embedded checksum or structure counts only if that holds. The kind ``hex`` has no keyword: its prefilter is the run
length of the bytes themselves.

Base kinds (in order): assign, access, hex. Added kinds with an embedded checksum: ``crc_token`` (prefix, 30 base-62
characters, then the CRC-32 of these in 6 base-62 characters), ``xprv`` (extended private key, base-58 with a double
SHA-256), ``age_key`` (secret key in bech32). Added kinds with an embedded structure: ``jwt`` (three base64url parts, the
first a JSON object with "alg"), ``pem_key`` (a private key block whose body is valid base64 of one DER sequence of just
its length). Spans are code points, end exclusive; of one kind they don't overlap, the leftmost counts; ties in place go
by the order of kinds.

Null and empty texts have no spans, repeated rows and null ids are scanned row by row, an empty table gives no rows, other
columns are ignored (or passed through by ``redact_secrets``), whatever their names. Texts are scanned whole, in time
linear in their length: a keyword inside a run that its kind has failed on is not tried again.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bare, read

KINDS = ("assign", "access", "hex", "crc_token", "jwt", "pem_key", "xprv", "age_key")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# The contract's patterns and the public formats of tokens.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CRC_TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM_KEY = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
TOKEN_RUN = re.compile(rb"[A-Za-z0-9_-]*")
XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107,108}(?![1-9A-HJ-NP-Za-km-z])")
AGE_KEY = re.compile(rb"AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])")
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword in lower case, the kind it opens.
KEYWORDS = [
    ("password", "assign"),
    ("passwd", "assign"),
    ("secret", "assign"),
    ("token", "assign"),
    ("apikey", "assign"),
    ("api_key", "assign"),
    ("akia", "access"),
    ("ghp_", "crc_token"),
    ("gho_", "crc_token"),
    ("ghu_", "crc_token"),
    ("ghs_", "crc_token"),
    ("ghr_", "crc_token"),
    ("npm_", "crc_token"),
    ("eyj", "jwt"),
    ("-----begin ", "pem_key"),
    ("xprv", "xprv"),
    ("age-secret-key-1", "age_key"),
]


def crc_base62(body: bytes) -> bytes:
    x, out = binascii.crc32(body), bytearray()
    for _ in range(6):
        x, r = divmod(x, 62)
        out.append(BASE62[r])
    return bytes(reversed(out))


def _b64url(part: bytes) -> bytes:
    return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))


def _valid_jwt(m: re.Match) -> bool:
    try:
        head = json.loads(_b64url(m[0].split(b".")[0]))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _valid_pem(m: re.Match) -> bool:
    try:
        der = base64.b64decode(re.sub(rb"\s", b"", m[2]), validate=True)
    except binascii.Error:
        return False
    if len(der) < 2 or der[0] != 0x30:
        return False
    size = der[1] - 128 if der[1] > 128 else 0  # bytes of a long length
    length = int.from_bytes(der[2 : 2 + size], "big") if size else der[1]
    return len(der) == 2 + size + length


def _valid_base58(m: re.Match) -> bool:
    number = 0
    for c in m[0]:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes(82, "big") if number < 1 << 656 else b""
    return raw[:1] == b"\x04" and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_rest(prefix: bytes, values: list[int]) -> int:
    """1 for values that end with their checksum."""
    low = prefix.lower()
    rest = 1
    for v in [*(c >> 5 for c in low), 0, *(c & 31 for c in low), *values]:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            rest ^= step if top >> i & 1 else 0
    return rest


def _valid_bech32(m: re.Match) -> bool:
    return bech32_rest(b"AGE-SECRET-KEY-", [BECH32.index(c) for c in m[1]]) == 1


#: kind: pattern, what a match must fulfil.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "crc_token": (CRC_TOKEN, lambda m: crc_base62(m[1][:30]) == m[1][30:]),
    "jwt": (JWT, _valid_jwt),
    "pem_key": (PEM_KEY, _valid_pem),
    "xprv": (XPRV, _valid_base58),
    "age_key": (AGE_KEY, _valid_bech32),
}

_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS:
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by the order of ``KINDS``."""
    raw = text.encode("utf-8")
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    done: dict[str, int] = {}
    for last, (length, kind) in _keywords().iter(raw.lower().decode("latin-1")):
        start = last - length + 1
        if start < done.get(kind, 0):  # inside the kind's last match
            continue
        pattern, valid = RULES[kind]
        if m := pattern.match(raw, start):
            done[kind] = m.end()
            if valid(m):
                found.append((start, m.end(), kind))
        elif kind == "jwt":  # no later start in this run has other dots behind it
            done[kind] = TOKEN_RUN.match(raw, start).end()
    found.sort(key=lambda s: (s[0], _ORDER[s[2]], s[1]))
    if len(raw) != len(text):
        place, at, points = {}, 0, 0
        for p in sorted({p for s in found for p in s[:2]}):
            points += len(raw[at:p].decode("utf-8"))
            at, place[p] = p, points
        found = [(place[a], place[b], k) for a, b, k in found]
    return found


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds array<string>, starts, ends array<bigint>, base_sha256) of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            kinds, starts, ends, digests = [], [], [], []
            for text in batch.column(1):
                spans = find_secrets(text.as_py() or "")
                kinds.append([k for _, _, k in spans])
                starts.append([a for a, _, _ in spans])
                ends.append([b for _, b, _ in spans])
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if _ORDER[k] < 3)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(digests, pa.string())],
                names=["doc_id", "kinds", "starts", "ends", "base_sha256"],
            )

    return bare(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, base_sha256 string"
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced and ``n_chars`` set anew where it is present; all rows stay."""

    @F.pandas_udf("string")
    def cleaned(column):
        return column.map(lambda t: t if t is None else redact(t, find_secrets(t), mark))

    out = docs.withColumn("text", cleaned(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")
    spans = F.array_join(F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s.kinds, s.starts.cast("string"), s.ends.cast("string"))), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), "base_sha256", spans.alias("spans"))
