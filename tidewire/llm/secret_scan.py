"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits,
then checks of the values themselves.

One automaton over all keywords walks each text once.  An expression is tried
only where a keyword was found, anchored there, so its cost follows the number
of hits and not the length of the text.  Long runs of lower-case hexadecimal
digits have no keyword; a run of 24 is its own prefilter.

Kinds, in this order: ``assign``, ``access`` and ``hex`` are the base;
``github`` and ``npm`` are tokens whose last six characters are a base-62
CRC-32 of the rest, ``jwt`` is three base64url parts whose first two decode to
JSON objects, and ``pem`` is a private key whose body is base64 and whose end
line names the same kind of key.  A candidate that fails its check is no span.

Defined cases: a null or empty text has no spans; repeated rows are scanned
alike; other columns are not read (``redact`` returns them unchanged); there is
one result row per input row.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Kinds in their listing order, and the keywords that lead to each.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]+"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]+"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]*+)\.(eyJ[A-Za-z0-9_-]*+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN ((?:[A-Z]+ ){0,2}PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END ((?:[A-Z]+ ){0,2}PRIVATE KEY)-----"),
}
_PART = re.compile(rb"[A-Za-z0-9_-]*+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # the maximal runs of 24 characters or more
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> str:
    n, out = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(6, "0")


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        body = m[0][4:]
        return len(body) == 36 and base62_crc(body[:30]) == body[30:].decode()
    if kind == "jwt":
        return _json_part(m[1]) and _json_part(m[2])
    body = b"".join(m[2].split())
    try:
        return m[1] == m[3] and len(base64.b64decode(body, validate=True)) >= 16
    except binascii.Error:
        return False


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (len(word) - 1, kind))
    auto.make_automaton()
    return auto


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in byte offsets, by start and then kind."""
    found, free = [], dict.fromkeys(KINDS, 0)
    for last, (back, kind) in _automaton().iter(text.lower().decode("latin-1")):
        at = last - back
        if at < free[kind]:
            continue
        if m := PATTERNS[kind].match(text, at):
            free[kind] = m.end()
            if _valid(kind, m):
                found.append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt":
            # A later hit in the same part reads the same characters to the same end, and fails as well.
            free[kind] = _PART.match(text, at).end()
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not found:
        return found
    at, n, point = 0, 0, {}
    for i in sorted({x for a, _, b in found for x in (a, b)}):
        n += len(text[at:i].decode("utf-8", "replace"))
        at, point[i] = i, n
    return [(point[a], k, point[b]) for a, k, b in found]


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans in code points, and the number of checked ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_checked", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        for b in A.pieces(batches):
            out = []
            for t in A.texts(b["text"]):
                found = _points(t, spans(t))
                base = [x for x in found if x[1] < 3]
                n = [sum(k == i for _, k, _ in found) for i in range(3)]
                out.append((*n, len(found) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            yield A.batch(schema, b["doc_id"], *map(list, zip(*out, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


def _redacted(text: bytes, mark: bytes) -> bytes:
    out, at = [], 0
    for a, _, b in spans(text):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return b"".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents with all columns; each run of overlapping spans is replaced by ``mark`` and ``n_chars``, if there, counts the new text."""

    def rows(batches):
        for b in A.pieces(batches):
            names = b.schema.names
            at = names.index("text")
            given = b.column(at)
            kept = given.is_valid().to_pylist()
            new = [_redacted(t, mark.encode()) if ok else None for t, ok in zip(A.texts(given), kept, strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array([None if t is None else t.decode("utf-8", "replace") for t in new], given.type)
            if "n_chars" in names:
                i = names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([n if t is None else len(t.decode("utf-8", "replace")) for n, t in zip(old, new, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(rows, docs.schema)
