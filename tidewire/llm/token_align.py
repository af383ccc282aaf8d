"""Alignment of two tokenizers over all documents, through a dictionary of groups.

Both tokenizers read the same bytes.  Where a token of A and a token of B end at
the same byte, a *group* ends: the tokens of both since the last such place,
written ``a1,a2|b1``.  The tokens that end together are *linked*.

1. A task walks its texts in pieces of bounded size.  Texts are cut into chunks
   at single spaces where neither tokenizer has a token over the cut (see CUT), so
   a chunk is encoded once per piece however often it stands there.  Each piece
   interns its groups: a distinct group is written once with a local code and its frequency,
   a document keeps its own codes and frequencies.  Piece and documents go to a
   table in the shared folder, so no later step tokenises again.
2. The pieces' dictionaries meet by group: one row for each distinct group of the
   corpus, with its frequency in links and its number of documents.
3. The links of each distinct group are expanded once and counted by frequency.
   Tokens that end at the same byte are one a suffix of the other, so there are
   at most as many id pairs as the vocabularies have bytes (``most_pairs``): that
   proves the bound of the one broadcast here.
4. Results are joined back by group to the pieces' dictionaries, and piece by
   piece to the documents: a row per piece and group, not per document and group,
   and no group has more rows than there are pieces.

Defined cases: a null or empty text, and one whose tokens do not spell a space
and the text, has no tokens (zeros, no digest); strings of special tokens in a
text are text; repeated rows are documents of their own and count as such; a null
doc_id is kept; other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .session import stored

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A single space between characters that are surely not white space.  A reads a space with what follows it, so a token starts there; B has no piece in which its space mark follows
#: another character (checked when it is loaded), so no merge goes over it.
CUT = re.compile("(?<=[!-~\u00c0-\u024f]) (?=[!-~\u00c0-\u024f])")
KNOWN = 300_000  # encoded chunks that a worker remembers between pieces
LONG = 32  # tokens from which a group is interned as a whole and not token by token


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@dataclass
class Tokens:
    """Ids of a piece's rows, one row after the other."""

    ids: np.ndarray
    off: np.ndarray


class Pair:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))

    def chunks(self, text: str) -> list[str]:
        return (CUT.split(text) if self.cuts else [text]) if text else []

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and B as packed numbers; empty where either does not spell a space and the text."""
        out = []
        for t, a, b in zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            whole, a = b" " + t.encode(), a.ids
            ok = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if ok else (b"", b""))
        return out

    def encode(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The same, remembering short chunks."""
        new = [c for c in chunks if c not in self.known]
        made = dict(zip(new, self._encoded(new), strict=True)) if new else {}
        out = [made[c] if c in made else self.known[c] for c in chunks]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.known.update((c, v) for c, v in made.items() if len(c) < 64)
        return out


def tokens(packed: list[bytes]) -> Tokens:
    return Tokens(np.frombuffer(b"".join(packed), np.int32).astype(np.int64), np.append(0, np.cumsum([len(x) for x in packed], dtype=np.int64)) // 4)


@lru_cache(maxsize=1)
def pair(folder: str) -> Pair:
    return Pair(folder)


def most_pairs(both: Pair) -> int:
    """Bound on the id pairs that can be linked: of two tokens that end together one ends in the other, and of that many bytes there is one token, or two with a byte's own."""
    return 2 * int(both.a_size.sum() + both.b_size.sum())


def groups(a: Tokens, b: Tokens, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all groups in the tokens of A and of B, and the number of groups up to each row."""
    end_a, end_b = np.cumsum(a_size[a.ids]), np.cumsum(b_size[b.ids])
    # Rows without tokens in one have none in the other, and rows' bytes are equal, so ends are comparable over the whole piece.
    at = np.searchsorted(end_b, end_a)
    same = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a) if len(end_b) else np.empty(0, np.int64)
    ga, gb = same + 1, at[same] + 1
    return ga, gb, np.searchsorted(ga, a.off, "right")


def interned(a: Tokens, b: Tokens, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The code of every group, and each code's text; equal groups, token by token, have equal codes."""
    n = len(ga)
    first_a, first_b = np.append(0, ga[:-1]), np.append(0, gb[:-1])
    size_a, size_b = ga - first_a, gb - first_b
    code = np.zeros(n, np.int64)
    short = np.flatnonzero(size_a + size_b <= LONG)

    def step(rows: np.ndarray, value: np.ndarray) -> None:
        """Codes of the rows told apart by one more value."""
        code[rows] = pd.factorize(code[rows] * (1 << 32) + value)[0]

    step(short, size_a[short] * (LONG + 1) + size_b[short])
    for first, size, ids in ((first_a, size_a, a.ids), (first_b, size_b, b.ids)):
        for k in range(int(size[short].max(initial=0))):
            # Rows that have ended keep apart: their sizes, and so their codes, differ from all others.
            more = size[short] > k
            step(short, np.where(more, ids[np.minimum(first[short] + k, len(ids) - 1)] + 1, 0))
    known: dict[bytes, int] = {}
    used = int(code[short].max(initial=-1)) + 1
    for i in np.flatnonzero(size_a + size_b > LONG).tolist():
        whole = a.ids[first_a[i] : ga[i]].tobytes() + b"|" + b.ids[first_b[i] : gb[i]].tobytes()
        code[i] = used + known.setdefault(whole, len(known))
    _, where = np.unique(code, return_index=True)

    def told(ids: np.ndarray) -> str:
        return ",".join(map(str, ids.tolist()))

    return code, [f"{told(a.ids[first_a[i]:ga[i]])}|{told(b.ids[first_b[i]:gb[i]])}" for i in where.tolist()]


#: Rows of the table: a document (its numbers, digest, codes and frequencies), or a distinct group of the piece (``word`` not null).
ROW = pa.schema(
    [("piece", pa.string()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
    + [("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("word", pa.string()), ("code", pa.int32()), ("frequency", pa.int64()), ("documents", pa.int64())]
)
_FIELDS = "piece string, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<int>, times array<int>, word string, code int, frequency long, documents long"


def _chunked(texts: list[str], both: Pair) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Codes of the chunks of all texts, their offsets by text, and the encoded chunks.

    A text with a chunk that is not spelled is judged as a whole, as one chunk; if it fails too it has none.
    """
    code: dict[str, int] = {}
    of = [[code.setdefault(c, len(code)) for c in both.chunks(t)] for t in texts]
    packed = both.encode(list(code))
    failed = {i for i, (a, _) in enumerate(packed) if not a}
    if failed:
        whole = [i for i, codes in enumerate(of) if not failed.isdisjoint(codes)]
        for i, ids in zip(whole, both._encoded([texts[i] for i in whole]), strict=True):
            of[i] = [len(packed)] if ids[0] else []
            packed.append(ids)
    off = np.append(0, np.cumsum([len(x) for x in of], dtype=np.int64))
    return np.fromiter((c for codes in of for c in codes), np.int64, int(off[-1])), off, packed


def _piece(ids: pa.Array, texts: list[str], both: Pair) -> Iterator[pa.RecordBatch]:
    chunk, off, packed = _chunked(texts, both)
    used, chunk = np.unique(chunk, return_inverse=True)  # chunks of texts that failed are gone
    a, b = (tokens([packed[i][side] for i in used.tolist()]) for side in (0, 1))
    ga, gb, upto = groups(a, b, both.a_size, both.b_size)
    code, words = interned(a, b, ga, gb)
    n, name, m = len(texts), uuid.uuid4().hex, len(words)
    named = np.array(words, object)
    told = np.array([";".join(named[code[i:z]].tolist()) for i, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], object)
    digests = [hashlib.sha256(";".join(told[chunk[i:z]].tolist()).encode()).hexdigest() if z > i else "" for i, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    n_a, n_b, n_groups = (A.sums(np.diff(v)[chunk], off) for v in (a.off, b.off, upto))
    # Distinct chunks of each text, then their groups.
    wide = max(len(used), 1)
    key, many = np.unique(np.repeat(np.arange(n), np.diff(off)) * wide + chunk, return_counts=True)
    row, which = key // wide, key % wide
    size = np.diff(upto)[which]
    group = code[np.repeat(upto[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    key, back = np.unique(np.repeat(row, size) * max(m, 1) + group, return_inverse=True)
    times = np.bincount(back, np.repeat(many, size), len(key)).astype(np.int64)
    of, codes = key // max(m, 1), key % max(m, 1)
    cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (codes, times)]
    yield A.batch(ROW, [name] * n, ids, n_a, n_b, n_groups, digests, *lists, *(pa.nulls(n, ROW.field(i).type) for i in range(8, 12)))
    if words:
        frequency = np.bincount(codes, times, m).astype(np.int64)
        yield A.batch(ROW, [name] * m, *(pa.nulls(m, ROW.field(i).type) for i in range(1, 8)), words, np.arange(m), frequency, np.bincount(codes, minlength=m))


def encoded(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Documents and the group dictionaries of their pieces, as described at ROW."""

    def rows(batches):
        for b in A.pieces(batches):
            yield from _piece(b["doc_id"], b["text"].fill_null("").to_pylist(), pair(folder))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, _FIELDS)


def _last(side: int):
    return F.substring_index(F.split_part("word", F.lit("|"), F.lit(side)), ",", -1).cast("int")


def dictionary(pieces: DataFrame) -> DataFrame:
    """(word, frequency, documents, a, b) of every distinct group; the one link of a group is between its last tokens, which alone end together."""
    words = pieces.where("word IS NOT NULL").groupBy("word").agg(F.sum("frequency").alias("frequency"), F.sum("documents").alias("documents"))
    return words.select("*", _last(1).alias("a"), _last(2).alias("b"))


def links(words: DataFrame) -> DataFrame:
    """(a, b, count, documents at most, best): every linked id pair of the corpus; ``best`` if no pair with that b has a higher count."""
    counted = words.groupBy("a", "b").agg(F.sum("frequency").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the results of their groups; a piece's groups come before its documents."""
    name, count, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        pieces = b["piece"].to_pylist()
        cuts = [0, *(i for i in range(1, len(pieces)) if pieces[i] != pieces[i - 1]), len(pieces)] if pieces else [0]
        for i, z in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(i, z - i)
            if pieces[i] != name:
                name, count, best = pieces[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
            group = part.filter(part["code"].is_valid())
            if len(group):
                code = group["code"].to_numpy()
                size = max(len(count), int(code.max()) + 1)
                count, best = (np.append(v, np.zeros(size - len(v), np.int64)) for v in (count, best))
                count[code], best[code] = group["count"].to_numpy(), group["best"].to_numpy(zero_copy_only=False)
            docs = part.filter(part["code"].is_null())
            if len(docs):
                lists = docs["codes"]
                code, times = lists.flatten().to_numpy(), docs["times"].flatten().to_numpy().astype(np.int64)
                off = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                yield A.batch(OUT, docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_groups"], A.sums(best[code] * times, off), A.sums(count[code] * times, off), docs["groups_sha256"])


def align(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    pieces = stored(encoded(docs, folder))
    words = stored(dictionary(pieces))
    # Bounded by the vocabularies' bytes, see most_pairs.
    told = words.join(F.broadcast(links(words)), ["a", "b"]).select("word", "count", "best")
    mine = pieces.where("word IS NOT NULL").select("piece", "word", "code").join(told, "word").select("piece", "code", "count", "best")
    documents = pieces.where("word IS NULL").drop("word", "code", "frequency", "documents")
    met = mine.unionByName(documents, allowMissingColumns=True)
    return met.repartition("piece").sortWithinPartitions("piece", F.col("code").asc_nulls_last()).mapInArrow(_told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
