"""SimHash, suffix arrays, Lempel-Ziv parsing, decontamination and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import decontam, repeats, rlz_dedup, simhash, suffix_dedup, suffixes
from tidewire.operators.components import components

CLASH = (("fp", 1), ("rep", 2), ("h", 3), ("gone", "x"), ("open", "y"), ("kept", 1))


def plain_suffixes(rows, size=100):
    first, out = {}, {}
    for i, t in sorted(set(rows)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in first:
                gone[p : p + size] = b"\x01" * size
            else:
                first[w] = p
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def plain_windows(rows, size=13):
    first, out = {}, {}
    for i, t in sorted(set(rows)):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), i) < i:
                gone[p : p + size] = [True] * size
        kept = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    """Copies, shared passages, periodic texts and short rows over a small vocabulary."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [say(rng.randint(12, 60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 400), (5, "ab " * 200), (6, "ab " * 190 + "c"), (7, "x" * 101)]
    for i in range(8, n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else say(rng.randint(0, 40)) for _ in range(rng.randint(1, 5))]
        text = rng.choice(rows)[1] if rng.random() < 0.15 else ("\n" if rng.random() < 0.3 else " ").join(parts)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 8192), (2, 3)])
def test_repeats_match_brute_force(docs_of, seed, shard):
    rows = corpus(seed)
    docs = docs_of([*rows, rows[10], rows[4]], CLASH)
    got = suffix_dedup.remove(docs, shard=shard).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_suffixes(rows)
    got = rlz_dedup.remove(docs, shard=shard).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_windows(rows)


def test_rows_without_id_lose_nothing(docs_of):
    docs = docs_of([(None, "z" * 300), (None, "z" * 300), (5, "q" * 50)])
    assert [r.n_removed for r in suffix_dedup.remove(docs).collect() if r.doc_id is None] == [0, 0]
    assert suffix_dedup.remove(docs_of([])).count() == rlz_dedup.remove(docs_of([])).count() == 0


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(3)
    texts = [b"", b"aaaaaaaaaaaaaaaaaaaa", b"abababab\x00", b"aaaaaaa", b"banana", bytes(rng.integers(97, 99, 60, dtype=np.uint8)), b"banana"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    tail = lambda p: data[p : off[np.searchsorted(off, p, "right")]].tobytes()
    for sa, lcp, _ in (suffixes.of_bytes(data, off), suffixes.of_words(data.astype(np.uint64), off)):
        order = sorted(range(len(data)), key=lambda p: (tail(p), p))
        assert sa.tolist() == order
        want = [0]
        for a, b in zip(order, order[1:], strict=False):
            x, y = tail(a), tail(b)
            want.append(next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y))))
        assert lcp.tolist() == want


def block_of(texts):
    words = sorted({w for t in texts for w in t})
    tokens = np.array([words.index(w) for t in texts for w in t], np.int64)
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    return rlz_dedup.Block(tokens, off, np.repeat(np.arange(len(texts)), np.diff(off))), off


def test_greedy_factors_are_longest_matches_in_smaller_documents():
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 25))) for _ in range(30)]
    block, off = block_of(texts)
    start, size = rlz_dedup.factors(block, off)
    want = []
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            k = max((k for k in range(len(t) - at + 1) if any(t[at : at + k] in u for u in texts[:i])), default=0)
            want.append((int(off[i]) + at, max(k, 1)))
            at += max(k, 1)
    assert list(zip(start.tolist(), size.tolist(), strict=True)) == want
    found = rlz_dedup.parse(block, off, 5)
    for i, t in enumerate(texts):
        for at in range(len(t)):
            window = t[at : at + 5]
            assert found[off[i] + at] == (len(window) == 5 and any(window in u for u in texts[:i]))


def test_places_inside_a_factor_are_not_looked_up():
    text = [f"w{i}" for i in range(200)]
    block, off = block_of([text, text])
    found = rlz_dedup.parse(block, off, 13)
    assert found.sum() == 188 and found[200:388].all()
    # 200 literals of the first document and the one factor of the second begin a search each, and no window is looked up in the second.
    literal_windows = 0
    assert block.lookups == 201 + literal_windows


def test_arrays_of_shards_merge_by_binary_search():
    rng = np.random.default_rng(5)
    for other in (False, True):
        kind = repeats.Kind(words=True, window=3, gram=2, other_document=other)
        arrays = []
        for _ in range(4):
            a = np.zeros(40, repeats._OPEN)
            a["digest"], a["doc"], a["lo"] = rng.integers(0, 30, 40), rng.integers(0, 6, 40), rng.permutation(40)
            a.sort(order=["digest", "doc", "lo"])
            arrays.append(a)
        rows = [tuple(int(x) for x in r)[:3] for a in arrays for r in a]
        later = lambda r: any(q[0] == r[0] and (q[1] < r[1] or not other and q[1:] < r[1:]) for q in rows)
        assert sorted(tuple(int(x) for x in r)[:3] for r in repeats.merged(arrays, kind)) == sorted(r for r in rows if later(r))


def test_rows_that_share_an_id_and_differ_in_text(docs_of):
    long, other = "lorem ipsum dolor sit amet " * 30, " ".join(f"word{i}" for i in range(300))
    rows = [(1, other), (2, long), (2, "short"), (2, other), (2, other)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz_dedup.remove(docs_of(rows)).collect())
    assert got == [(1, 300, 0), (2, 1, 0), (2, 150, 0), (2, 300, 300), (2, 300, 300)]
    assert sorted(r.n_bytes for r in suffix_dedup.remove(docs_of(rows)).collect()) == sorted(len(t) for _, t in rows)


def test_joined_ranges():
    d, _, lo, n = repeats._joined(np.array([2, 1, 1, 1]), np.zeros(4, np.int32), np.array([0, 5, 0, 2]), np.array([3, 1, 3, 2]))
    assert list(zip(d.tolist(), lo.tolist(), n.tolist(), strict=True)) == [(1, 0, 4), (1, 5, 1), (2, 0, 3)]


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 700, dtype=np.int64).astype(np.uint64)
    for _ in range(300):
        x = int(f[rng.integers(0, 700)])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        f[rng.integers(0, 700)] = x
    for upto in (np.full(700, 700), np.minimum(700, (np.arange(700) // 37 + 1) * 37)):
        for radius in (0, 3, 4):
            got = {p for a, b in simhash.near(f, upto, radius, 500) for p in zip(a.tolist(), b.tolist(), strict=True)}
            assert got == {(i, j) for i in range(700) for j in range(i + 1, upto[i]) if bin(int(f[i] ^ f[j])).count("1") <= radius}


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash_groups(docs_of, spark, tile, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(80)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one  TWO"), (5, "ÉTÉ x"), (6, "été x")]
    for i in range(7, 70):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(simhash, "TILE", tile)
    docs = docs_of([*rows, rows[9], (None, "one two")], CLASH)
    got = simhash.cluster(docs).collect()
    assert len(got) == len(rows) + 2
    lower = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode()
    fp = {i: simhash.fingerprint(re.findall(rb"[^\x20\x09-\x0D]+", lower(t))) for i, t in rows}
    root = dict(zip(fp, fp, strict=True))
    for _ in fp:
        for i in fp:
            for j in fp:
                if bin(fp[i] ^ fp[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    by = {r.doc_id: r for r in got}
    assert {i: (by[i].fingerprint, by[i].component_id) for i in fp} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert by[None].component_id is None
    kept = simhash.one_of_each(docs, similar=None)
    assert kept.schema.names == docs.schema.names
    assert {r.doc_id for r in kept.collect()} == {i for i in fp if root[i] == i} | {None}


@pytest.mark.parametrize("tile", [simhash.TILE, 4])
def test_one_of_each_joins_like_shingle_sets(docs_of, spark, tile, monkeypatch):
    """Kept documents are those of the groups of exact Jaccard 0.8, with fingerprint links."""
    rng = random.Random(11)
    texts = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "three four five")]
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(4)]
    for i in range(5, 45):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 6, 20])):
            words[rng.randrange(len(words))] = f"new{i}"
        texts.append((i, " ".join(words)))
    links = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda docs, similar: links(docs, similar, tile))
    docs = docs_of([*texts, (None, texts[9][1])], CLASH)
    kept = simhash.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    got = {r.doc_id for r in kept.collect()}
    words = {i: (t or "").lower().encode().split() for i, t in texts}
    fp = {i: simhash.fingerprint(w) for i, w in words.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}

    def roots(least):
        root = {i: i for i in words}
        for _ in words:
            for i in words:
                for j in words:
                    alike = bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
                    if alike or bin(fp[i] ^ fp[j]).count("1") <= 4:
                        root[i] = root[j] = min(root[i], root[j])
        return {i for i in root if root[i] == i}

    assert got == roots(0.8) | {None}
    assert len(got) < len(words) - 10


@pytest.mark.parametrize("stars,tile", [(simhash.STARS, simhash.TILE), (0, 3)])
def test_shingle_sets_are_compared_exactly(docs_of, stars, tile, monkeypatch):
    """Pairs around Jaccard 0.8, of 5-word shingles each, and a line repeated 2 and 40 times."""
    monkeypatch.setattr(simhash, "STARS", stars)
    rng = random.Random(5)
    rows, want = [], set()

    def add(a, b, linked):
        i = len(rows)
        rows.extend([(i, " ".join(a)), (i + 1, " ".join(b))])
        if linked:
            want.add(frozenset((i, i + 1)))

    say = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(25):
        for common in (79, 80, 81):  # of a union of 100 shingles
            both, more = say(common + 4), say(100 - common)
            add(both + more, both, common >= 80)
        a, line = say(200), say(12)
        add(a + line * 2, a + line * 40, True)
    got = simhash.similar_links(docs_of(rows), 0.8, tile).collect()
    assert {frozenset((r.a, r.b)) for r in got} == want


def test_tiles_split_large_buckets(spark):
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 1 << 10, 60)]
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.root for r in components(simhash.links(classes, 4, 5)).collect()}
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r for i, r in enumerate(root) if root.count(r) > 1} == got


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (300, 41)] + [(500, 501 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200 and got[300] == 41 and got[530] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


BENCH = [(1, "The quick brown fox jumps over the lazy dog while seven wizards watch."), (2, None), (3, ""), (4, "short"), (5, "In which year did the river reach its highest mark at the old stone bridge?")]


def edited(text, k, rng):
    t = list(text)
    for _ in range(k):
        p = rng.randrange(len(t))
        t[p : p + 1] = rng.choice([[], [t[p], "q"], ["z"]])
    return "".join(t)


def test_decontamination(docs_of, spark):
    rng = random.Random(2)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    noise = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "the", "of"]) for _ in range(60))
    rows = [(0, None), (1, ""), (2, "short"), (3, noise()), (4, BENCH[0][1]), (5, noise() + " " + BENCH[4][1].upper() + "\n" + noise()), (6, BENCH[0][1][:30])]
    rows += [(10 + k, noise() + " " + edited(BENCH[4][1], k, rng) + " " + noise()) for k in range(4)]
    rows += [(30, BENCH[0][1] + BENCH[4][1])]
    docs = docs_of([*rows, rows[4], (None, BENCH[0][1])], CLASH)
    for limit in (decontam.BLOCK, 40):
        got = decontam.scan(docs, bench, limit=limit)
        by = {r.doc_id: r for r in got.collect()}
        assert got.count() == len(rows) + 2
        # Document 2 is the whole of item 4, which is too short for q-grams.
        assert {i for i, r in by.items() if r.contaminated and i is not None} == {2, 4, 5, 10, 11, 12, 13, 30}
        assert by[30].item_ids == [1, 5] and by[4].item_ids == [1]
    clean = decontam.clean(docs, bench)
    assert clean.schema.names == docs.schema.names
    assert {r.doc_id for r in clean.collect()} == {0, 1, 3, 6}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs, none).where("contaminated").count() == 0 and decontam.clean(docs, none).count() == docs.count()
    assert decontam.scan(docs_of([]), bench).count() == 0


def least_edits(pattern, text):
    """Of a pattern anywhere in a text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_q_gram_filter_loses_no_alignment():
    import pyarrow as pa

    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(12, 40)))) for i in range(5)]
    ix = decontam.index(items)
    hit = 0
    for _ in range(30):
        j = rng.randrange(len(items))
        text = "xx " + edited(items[j][1], rng.randint(0, int(ix.edits[j])), rng) + " yy"
        plain = np.frombuffer(text.encode(), np.uint8)
        normal = decontam._normal(plain, np.array([0, len(plain)]))[0].tobytes()
        want = {i for i, _ in items if least_edits(ix.patterns[i].tobytes(), normal) <= ix.edits[i]}
        found = decontam.hits(pa.array(["pad", text]), ix)
        assert {h[1] for h in found} == want
        hit += bool(want)
    assert hit > 15


def test_q_gram_filter_ignores_case_of_accented_letters():
    import pyarrow as pa

    item = "La éai éonleeau pour à éonqueê aivi çai þenaitreo × oiaux éoiré anvitre"
    ix = decontam.index([(7, item)])
    assert [h[0] for h in decontam.hits(pa.array(["", item.upper(), "à" * 80, item]), ix)] == [1, 3]


def test_decontamination_is_the_same_for_any_number_of_blocks(docs_of, spark):
    bench = spark.createDataFrame([*BENCH, (6, "Stone bridge"), (7, BENCH[0][1]), (8, "!!")], "item_id long, text string")
    hit = "xx " + BENCH[0][1] + " yy " + BENCH[4][1]
    rows = [(1, hit), (1, hit), (None, hit), (None, hit), (2, "a stone BRIDGE stood"), (3, "gravestone bridge"), (3, "stone bridges"), (4, "Short."), (5, None), (6, "!!"), (None, None)]
    docs = docs_of(rows, CLASH)
    one, many = ([tuple(r) for r in decontam.scan(docs, bench, limit=limit).collect()] for limit in (decontam.BLOCK, 40))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == len(rows)
    assert Counter((r[0], tuple(r[2])) for r in one) == Counter({(1, (1, 5, 6, 7)): 2, (None, (1, 5, 6, 7)): 2, (2, (6,)): 1, (3, ()): 2, (4, (4,)): 1, (5, ()): 1, (6, ()): 1, (None, ()): 1})
    kept = lambda limit: Counter(r.doc_id for r in decontam.clean(docs, bench, limit=limit).collect())
    assert kept(40) == kept(decontam.BLOCK) == Counter({3: 2, 5: 1, 6: 1, None: 1})


def test_capitals_of_all_scripts_are_folded():
    words = "ŁÓDŹ ДОМ ΑΒΓ ẠẢ Ⴀ 𐐀 ÀÞ× İ ẞ ß"
    data = np.frombuffer(words.encode(), np.uint8)
    got = decontam._normal(data, np.array([0, len(data)]))[0].tobytes().decode()
    want = "".join(c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c for c in words)
    assert got == want != words
