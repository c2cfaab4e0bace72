"""The near-duplicates stage against brute force over all pairs of texts."""

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from formloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Ids of (doc_id, text) that stay: the least of each chain of texts at 0.8 or more."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return sorted(first.values())


def edited_rows():
    """Texts with one to four words replaced: similarities on both sides of 0.8, chains, copies, short and empty texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", None, "one two", "One  two", "one two three", " \n"]
    common = [word() for _ in range(30)]
    for base in [[word() for _ in range(rng.choice([24, 60, 120, 400]))] for _ in range(25)] + [common + [word() for _ in range(20)] for _ in range(15)]:
        texts.append(" ".join(base))
        for _ in range(6):
            edited = list(base)
            for _ in range(rng.randrange(1, 5)):
                edited[rng.randrange(len(base))] = word()
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates_are_five_word_sets_at_four_fifths(spark):
    rows = edited_rows()
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want
    assert 60 < len(want) < len(rows) - 60


def test_large_families_are_compared_in_tiles(spark, monkeypatch):
    """One text edited over and over: most pairs lie on either side of 0.8, and few links leave the tasks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 150):
        edited = list(base)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(len(base))] = f"e{rng.randrange(9000)}"
        rows.append((d, " ".join(edited)))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], SCHEMA).repartition(3)
    want = brute_kept(rows)
    assert 5 < len(want) < 100
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want
    monkeypatch.setattr(simhash, "TILE", 16)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == want


def test_candidates_come_from_vantage_point_trees(spark, monkeypatch):
    """A tree for each block, with many shards and small leaves; no pair that is close in a block is lost, and rows are brute force's."""
    grown, tree = [], simhash.VpTree

    def grow(*args):
        grown.append(tree(*args))
        return grown[-1]

    monkeypatch.setattr(simhash, "VpTree", grow)
    monkeypatch.setattr(simhash, "WIDE_SHARD", 24)
    monkeypatch.setattr(simhash, "WIDE_LEAF", 8)
    rows = edited_rows()
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == brute_kept(rows)
    assert len(grown) == simhash.BLOCKS and min(t.leaves for t in grown) > 4

    node, sig, size = (c.to_pylist() for c in simhash._wide()([(t or "").encode() for _, t in rows]))
    sketches = {n: (s, z) for n, s, z in zip(node, sig, size, strict=True)}
    sets = spark.createDataFrame([(n, z, bytearray(s)) for n, (s, z) in sketches.items()], "node long, size long, sig binary").repartition(3)
    together = {}
    for r in simhash._met(sets).collect():
        together.setdefault((r.band, r.bucket), set()).add(r.node)
    met = {(band, *sorted(p)) for (band, _), members in together.items() for p in combinations(members, 2)}
    bits = {n: np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little") for n, (s, _) in sketches.items()}
    close = 0
    for a, b in combinations(sorted(bits), 2):
        apart = (bits[a] != bits[b]).reshape(simhash.BLOCKS, 16).sum(axis=1)
        if apart[:12].sum() <= simhash.CHECK and 5 * min(sketches[a][1], sketches[b][1]) >= 4 * max(sketches[a][1], sketches[b][1]):
            for band in np.flatnonzero(apart <= simhash.CLOSE):
                close += 1
                assert (band, a, b) in met
    assert close > 1000


def test_bits_of_wide_fingerprints_differ_by_the_angle():
    """Sets that share 280 of 320 shingles differ in acos(7/8) / pi of the bits, blocks in as many as independent bits would; unlike sets differ in half."""
    rng = random.Random(2)
    text = lambda words: " ".join(words).encode()
    pairs, others = [], []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(364)]
        pairs += [text(words[:324]), text(words[40:])]  # 320 shingles each, 280 shared: 7/9
        others += [text(words[:180]), text(words[184:])]

    def apart(texts):
        sig = np.unpackbits(np.array([np.frombuffer(s, np.uint8) for s in simhash._wide()(texts)[1].to_pylist()]), axis=1, bitorder="little")
        return (sig[::2] != sig[1::2]).reshape(-1, simhash.BLOCKS, 16).sum(axis=2)

    near, far = apart(pairs), apart(others)
    assert abs(near.mean() / 16 - np.arccos(7 / 8) / np.pi) < 0.01
    assert abs((near <= simhash.CLOSE).mean() - 0.2463) < 0.03
    assert abs(far.mean() / 16 - 0.5) < 0.01 and (far <= simhash.CLOSE).mean() < 0.002


def test_the_filter_of_keys_drops_no_row_of_the_join(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("concat('k', id) AS _k", "id AS text").repartition(3)
    keys = rows.where("text % 7 = 3").select("_k")
    want = {r.text for r in rows.join(keys, "_k").collect()}
    for bits in (6, 16, 26):  # full, in between, nearly empty
        monkeypatch.setattr(simhash, "FILTER_BITS", bits)
        some = simhash._likely(rows, keys, "_k")
        assert some.columns == rows.columns
        got = [r.text for r in some.collect()]
        assert want <= set(got) and len(got) == len(set(got))
        assert bits != 26 or len(got) < len(want) + 20
    assert simhash._likely(rows, keys.limit(0), "_k").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_tile_pairs_are_whole_however_frames_cut_them(size):
    keys = [(1, 0, 0)] * 5 + [(1, 0, 1)] + [(1, 1, 1)] * 2 + [(2, 1, 1)] * 9 + [(-(2**63), 0, 0), (2**63 - 1, 0, 0)]
    rows = pd.DataFrame([(*k, i) for i, k in enumerate(keys)], columns=[*simhash.PAIR, "node"]).astype({"low": "int32", "high": "int32"})
    frames = [rows.iloc[:0], *(rows.iloc[i : i + size] for i in range(0, len(rows), size)), rows.iloc[:0]]
    got = [(tuple(f[simhash.PAIR].iloc[0]), list(f["node"])) for f in simhash._tile_pairs(iter(frames))]
    assert got == [(k, [i for i, x in enumerate(keys) if x == k]) for k in dict.fromkeys(keys)]
    assert list(simhash._tile_pairs(iter([]))) == []


@pytest.mark.parametrize("n_words", [0, 1, 4, 5, 6, 300])
def test_shingle_hashes_tell_the_same_sets_apart(n_words):
    words = [f"w{i % 40}" for i in range(n_words)]
    text = " ".join(words)
    assert len(simhash.shingles(text.encode())) == len(shingle_set(text))
    assert simhash.alike(simhash.shingles(text.encode()), simhash.shingles(text.upper().encode())) or not n_words
    if n_words > 1:
        turned = set(simhash.shingles(" ".join(reversed(words)).encode()).tolist())
        assert turned.isdisjoint(simhash.shingles(text.encode()).tolist())
