"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from parlance.llm.runs import collapse, factorise, find_runs, gram, prefixes, repeated, runs_of, text_runs


def brute(w, least, times):
    """Maximal stretches for each period, each with its smallest period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        start = 0
        for i in range(p, len(w) + 1):
            if i == len(w) or w[i] != w[i - p]:
                if i - start >= max(least, times * p):
                    found.setdefault((start, i), p)
                start = i - p + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words(rng):
    """Texts with nested, overlapping and touching repetitions."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 90))]
    if kind == 1:
        return list(fibonacci(rng.randint(1, 150)))
    out = []
    while len(out) < rng.randint(1, 150):
        part = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 9 if kind < 4 else 30))]
        out += part * rng.randint(1, 7) + part[: rng.randrange(len(part))]
    return out * (1 + rng.randrange(2))


def test_factors_are_the_longest_that_occurred_before():
    rng = random.Random(1)
    for _ in range(150):
        w = words(rng)
        at = 0
        for start, end, back in factorise(w):
            assert start == at
            longest = max((k for s in range(start) for k in range(len(w) - start + 1) if w[s : s + k] == w[start : start + k]), default=0) if len(w) < 60 else None
            assert longest is None or end - start == max(1, longest)
            assert back == 0 or w[start - back : end - back] == w[start:end]
            at = end
        assert at == len(w)


def test_all_runs_against_brute_force():
    rng = random.Random(2)
    for n in range(1500):
        w = words(rng)
        for least, times in ((2, 2), (5, 2), (6, 3), (24, 3)):
            want = brute(w, least, times)
            assert runs_of(w, least, times) == want, (n, least, times, w)
            raw = [x.encode() for x in w]
            if least > 2 or times > 2:
                assert text_runs(raw, least, times) == want, (n, least, times, w)


def test_stretches_set_aside_words_of_running_text():
    import numpy as np

    rng = random.Random(3)
    w = [rng.randrange(500) for _ in range(4000)]
    assert gram(24, 3) == 9 and repeated(np.array(w, np.uint64), 24, 3) == []
    w[1000:1100] = w[900:920] * 5
    w[3000:3200] = w[100:300]  # a passage that occurs twice isn't periodic
    (start, end), = repeated(np.array(w, np.uint64), 24, 3)
    assert start <= 1000 and end >= 1100 and end - start < 140
    assert prefixes(list("aabaab")) == [0, 1, 0, 3, 1, 0]


def test_very_long_texts_take_linear_time():
    import time

    rng = random.Random(4)
    unit = [b"%d" % rng.randrange(1000) for _ in range(400)]
    began = time.time()
    assert [(s, e, p) for s, e, p in text_runs(unit * 500, 24, 3)] == brute_of_unit(unit, 500)
    assert [(0, 200_000, 1)] == text_runs([b"a"] * 200_000, 24, 3)
    assert text_runs(list(map(str.encode, fibonacci(60_000))), 24, 3)
    assert time.time() - began < 60


def brute_of_unit(unit, n):
    inside = brute(unit * 4, 24, 3)
    assert inside == [(0, 4 * len(unit), len(unit))]
    return [(0, n * len(unit), len(unit))]


def plain(text):
    w = (text or "").encode().split()
    runs = brute(w, 24, 3)
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    return runs, best, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def awkward(rng):
    texts = [None, "", " \n\t", "a", "x " * 23, "x " * 24, "é é " * 30, "a\x1cb " * 40, "a b " * 400 + "c d e " * 9, "w\u0085 v\x0b" * 50]
    return texts + [" ".join(words(rng)) for _ in range(120)]


def test_find_runs_on_awkward_rows(spark):
    texts = awkward(random.Random(5))
    rows = [(None if k % 7 == 0 else k % 50, t, "clash", "clash", "clash") for k, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start string, COLLAPSED string")
    got = find_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        runs, best, kept = plain(r.text)
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == runs and r.collapsed == kept and r.start == "clash"
        assert (r.strongest and (r.strongest.start, r.strongest.start + r.strongest.length, r.strongest.period)) == best
    assert find_runs(df.limit(0)).count() == 0
    assert find_runs(df, carry=["doc_id"]).columns == ["doc_id", "runs", "strongest", "collapsed"]
    with pytest.raises(ValueError):
        find_runs(df, times=1)


def altered(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_on_awkward_documents(spark, tmp_path):
    from parlance.llm.queries import queries

    rng = random.Random(6)
    rows = [(rng.choice([None, -3, *range(300)]), t, "x") for t in awkward(rng) for _ in range(3)]
    rows += [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 300))), "x") for k in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    hexed = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t, _ in rows:
        w = altered(i, t)
        runs, best, kept = plain(b" ".join(w).decode())
        s, e, p = best or (None, None, None)
        listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs).encode()
        want.append((i, len(runs), s, best and e - s, p, best and 1000 * (e - s) // p, hexed(listed), hexed(kept.encode())))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 30
    spark.createDataFrame(rows[:0], "doc_id bigint, text string, runs string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries()["op11_periodic_runs"](spark, f"{tmp_path}/none").count() == 0


def test_collapse_keeps_the_first_period():
    w = [x.encode() for x in "a b a b a b a b c".split()]
    assert collapse(w, [(0, 8, 2)]) == [b"a", b"b", b"c"]
