"""The near-copy stage against brute force over exact shingle sets."""

import random

import numpy as np

import corpus_pipeline
from parlance.llm import near_copies
from parlance.llm.near_copies import apart, band_keys, compared, may_link, parity, shingles, simhash_pairs, words_of
from parlance.llm.simhash import majority


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def test_near_dedup_stage(spark):
    random.seed(3)
    rows = [(k, t) for k, t in enumerate(["", "one two", "ONE  two", "one two three"])]
    for base in range(12):
        words = [f"w{random.randrange(5000)}" for _ in range(300)]
        for copy in range(8):  # some within 0.8, some not, some only through others
            some = list(words)
            for at in random.sample(range(300), copy * 2):
                some[at] = f"new{random.randrange(10**6)}"
            rows.append((100 + base * 10 + copy, " ".join(some)))
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    want = {rows[r][0] for r in root}
    assert len(want) < len(rows) - 20
    docs = spark.createDataFrame([*rows, (None, rows[-1][1]), (3, rows[4][1] + " end")], "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([*want - {100}, 3])
    assert sum(r.doc_id is None for r in got) == 1 and ("one two three" in {r.text for r in got if r.doc_id == 3})
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    kept = {True: [], False: []}
    for size in (1, 3, 40, 500, 3000, 40_000):
        for share in np.repeat([0.6, 0.7, 0.78, 0.8, 0.82, 0.9, 1.0], 5):
            both = max(1, round(size * share))
            pool = np.unique(rng.integers(0, 1 << 64, 3 * size, np.uint64))
            rng.shuffle(pool)
            more = rng.integers(0, size - both + 1)
            sets = [np.sort(np.concatenate([pool[:both], part])) for part in (pool[both : both + more], pool[both + more : size])]
            x, y = ([band_keys(s)[1] + parity(s)] for s in sets)
            kept[5 * both >= 4 * size].append((size, bool(may_link(x, y)[0, 0])))
    assert all(k for _, k in kept[True])
    ruled_out = [not k for size, k in kept[False] if 500 <= size <= 3000]
    assert sum(ruled_out) >= 0.6 * len(ruled_out)
    assert may_link([], []).shape == (0, 0)


def test_blocks_of_a_large_group_meet(spark):
    """2,500 nodes of one group, in three blocks: the pairs that pass are those of a comparison of each with each."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 4000, np.uint64)
    rows = []
    for k in range(2500):
        part = np.unique(np.concatenate([pool[k // 50 * 40 : k // 50 * 40 + 40], rng.integers(0, 1 << 64, rng.integers(0, 9), np.uint64)]))
        root = b"main" if k % 50 < 45 and k < 2000 else b"r%d" % (k % 700)
        rows.append((1, b"n%04d" % k, root, b"main", band_keys(part)[1] + parity(part)))
    got = {tuple(map(bytes, r)) for r in compared(spark.createDataFrame(rows, "key bigint, node binary, root binary, main binary, sketch binary")).collect()}
    fits = may_link([r[4] for r in rows], [r[4] for r in rows])
    want = {(max(rows[i][1], rows[j][1]), min(rows[i][1], rows[j][1])) for i, j in zip(*np.nonzero(fits)) if rows[i][2] != rows[j][2]}
    assert got == want and len(want) > 1000


def test_near_dedup_goes_through_simhash(spark, monkeypatch):
    """The stage's fingerprints are majorities of the bits of five-word shingles' hashes, and what SimHash ties is verified before any band is."""
    words = [f"w{k}" for k in range(1500)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{k}" for k in range(90)), ""]
    hashes = [shingles(words_of(t)) for t in texts]
    fps = [majority(h) for h in hashes]
    assert all(fp == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)) for fp, h in zip(fps, hashes))
    assert (fps[0] ^ fps[1]).bit_count() <= 3 and majority(np.zeros(1000, np.uint64)) == 0
    seen, first = [], []
    real_links, real_verified = near_copies.links, near_copies.verified
    monkeypatch.setattr(near_copies, "links", lambda fps, *a: seen.extend(r.fp for r in fps.collect()) or real_links(fps, *a))
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: first.append(pairs.count()) or real_verified(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
    assert {x % (1 << 64) for x in seen} == set(fps)
    assert first[:2] == [1, 0]  # the pair comes from SimHash, the bands have nothing to add


def test_simhash_pairs_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 64, 60, np.uint64).tolist()
    fps = [b ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, False).astype(np.uint64))) if n else b for b in base for n in (0, 0, 1, 3, 5)]
    rows = [(b"n%03d" % k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)]
    got = {tuple(map(bytes, r)) for r in simhash_pairs(spark.createDataFrame(rows, "node binary, fp bigint")).collect()}
    least = {}
    for k, fp in enumerate(fps):
        least.setdefault(fp, b"n%03d" % k)
    want = {(b"n%03d" % k, least[fp]) for k, fp in enumerate(fps)} | {(max(least[x], least[y]), min(least[x], least[y])) for x in least for y in least if (x ^ y).bit_count() <= 3}
    assert got == {(a, b) for a, b in want if a != b} and len(got) >= 180
    pairs = spark.createDataFrame([(b"a", b"b"), (b"c", b"b"), (b"d", b"e")], "a binary, b binary")
    roots = spark.createDataFrame([(b"a", b"a"), (b"b", b"a"), (b"d", b"d")], "node binary, root binary")
    assert {tuple(map(bytes, r)) for r in apart(pairs, roots).collect()} == {(b"c", b"b"), (b"d", b"e")}
