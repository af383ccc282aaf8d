"""Hashes of ranges, exact codes, and texts made to collide under polynomials modulo a power of two."""

import random

import numpy as np
import pytest

from tidewire.llm import arrays as A
from tidewire.llm import quality, rlz_dedup, suffix_dedup
from tidewire.llm.suffixes import sequence_sums

from test_duplicate_operators import plain_suffixes, plain_windows


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


PAIR = (thue_morse(1024), thue_morse(1024, "b", "a"))


def test_products_and_powers_modulo_the_prime():
    r = random.Random(4)
    xs = [0, 1, A.PRIME - 1, *(r.randrange(A.PRIME) for _ in range(200))]
    a, b = (np.array(v, np.uint64) for v in (xs, xs[::-1]))
    assert A.mulmod(a, b).tolist() == [x * y % A.PRIME for x, y in zip(xs, xs[::-1], strict=True)]
    for which in (0, 1):
        up, down = A.powers(70_000, which)
        assert A.mulmod(up, down).max() == 1 == A.mulmod(up, down).min()
        assert int(up[3]) == pow(A._BASES[which], 3, A.PRIME)


@pytest.mark.parametrize("run", [7, 1 << 24])
def test_equal_ranges_have_equal_hashes_wherever_they_stand(run, monkeypatch):
    monkeypatch.setattr(A, "_RUN", run)
    data = np.frombuffer(b"abracadabra abracadabra xabracadabra" * 30, np.uint8)
    h = A.Hasher(data)
    at = np.arange(len(data) - 11)
    by = {}
    for i, v in zip(at.tolist(), h.ranges(at, at + 11).tolist(), strict=True):
        by.setdefault(data[i : i + 11].tobytes(), set()).add(v)
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for v in by.values()}) == len(by)
    sums = sequence_sums(np.array([5, 1 << 63, 7, 5, 1 << 63, 7], np.uint64))
    assert len(set(A.span_hash(*sums, np.array([0, 3]), np.array([3, 6])).tolist())) == 1


def test_words_made_to_collide_do_not():
    data = np.frombuffer(" ".join(PAIR).encode(), np.uint8)
    starts, ends, _ = A.word_bounds(data, np.array([0, len(data)]))
    assert len(set(A.Hasher(data).ranges(starts, ends).tolist())) == 2


def test_codes_are_exact_even_if_all_hashes_are_equal(monkeypatch):
    r = random.Random(6)
    words = [r.choice(["a", "b", "ab", "ba", "aab", *PAIR]) for _ in range(300)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = A.word_bounds(data, np.array([0, len(data)]))

    def check():
        codes = A.word_codes(data, starts, ends).tolist()
        assert len({(c, w) for c, w in zip(codes, words, strict=True)}) == len(set(codes)) == len(set(words))

    check()
    monkeypatch.setattr(A.Hasher, "ranges", lambda self, a, b: np.zeros(len(a), np.uint64))
    check()


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13])
def test_codes_of_runs_are_exact(size):
    r = random.Random(size)
    codes = np.array([r.randrange(2) for _ in range(500)])
    runs = A.run_codes(codes, size).tolist()
    want = [tuple(codes[i : i + size].tolist()) for i in range(len(codes) - size + 1)]
    assert len(set(zip(runs, want, strict=True))) == len(set(runs)) == len(set(want))
    assert len(A.run_codes(codes[:3], 8)) == 0


def adversarial():
    fill = " ".join(f"w{i}" for i in range(12))
    words = thue_morse(1024, "x ", "y ")
    return [
        (1, f"{PAIR[0]} {fill}"), (2, f"{PAIR[1]} {fill}"), (3, f"{fill} {PAIR[0]} {fill} {PAIR[1]} {fill}"), (4, words), (5, thue_morse(1024, "y ", "x ")), (6, PAIR[0]), (7, PAIR[1]),
        (8, "same " * 900), (9, "same " * 300), (10, "z" * 3000), (11, "z" * 900), (12, "ab" * 700 + PAIR[0] + "ab" * 300), (13, PAIR[1] + "ab" * 500),
    ]


def test_removal_by_words_and_bytes_of_colliding_texts(docs_of):
    rows = adversarial()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz_dedup.remove(docs_of(rows)).collect()}
    assert got == plain_windows(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(docs_of(rows)).collect()}
    assert got == plain_suffixes(rows)


def test_repeated_words_of_colliding_texts():
    import pyarrow as pa

    texts = [" ".join([*(f"u{i}" for i in range(7)), PAIR[0], *(f"u{i}" for i in range(7)), PAIR[1]]), *(t for _, t in adversarial())]
    repeat = quality._measure(pa.array(texts))[0][4].tolist()
    for text, n in zip(texts, repeat, strict=True):
        w = text.split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in windows if windows.count(x) > 1} if len(w) < 1500 else None
        if twice is not None:
            assert n == len({i + k for i, x in enumerate(windows) if x in twice for k in range(8)})
