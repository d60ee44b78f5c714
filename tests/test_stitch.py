"""Stitching against a loop over each recording."""

import random

import pytest

from parlance.operators import stitch


def fold(rows, tolerance=0.25):
    """One recording, row by row: (ord, start, end, text)."""
    out = []
    for ord_, start, end, text in sorted((r for r in rows if r[1] is not None or r[2] is not None or r[3]), key=lambda r: (1e12 if r[1] is None else r[1], r[0])):
        if out and out[-1][2] is not None and start is not None:
            if start < out[-1][2] - tolerance:
                start = out[-1][2]
            if end is not None and start >= end:
                if text:
                    out[-1][3] = f"{out[-1][3].rstrip()} {text.lstrip()}".strip() if out[-1][3] else text
                continue
        out.append([ord_, start, end, text])
    return [(o, s, e, (t or "").strip()) for o, s, e, t in out]


@pytest.mark.parametrize("seed,width", [(0, 600.0), (1, 3.0), (2, 0.5), (3, 40.0)])
def test_recordings_against_a_loop(spark, seed, width):
    rng = random.Random(seed)
    jobs = {}
    for j in [None, *range(30)]:
        n, at, rows = rng.randint(1, 60), 0.0, []
        for k in range(n):
            at += rng.choice([0.0, 0.1, 0.25, 0.3, 1.0, 2.5])
            start = rng.choice([at, at, at, at, at - 1, None if rng.random() < 0.3 else at])
            end = rng.choice([at + 0.1, at + 0.25, at + 0.2, at + 1, at + 1, at + 3, at + 15, at, at - 0.5, None if rng.random() < 0.4 else at + 1])
            rows.append((k, start and round(start, 2), end and round(end, 2), rng.choice([None, "", " ", "a", " b ", "c d", f"w{k}"])))
        jobs[j] = rows
    df = spark.createDataFrame([(j, *r) for j, rows in jobs.items() for r in rows], "job_id int, ord int, start double, end double, text string").repartition(6)
    got = {}
    for r in stitch.stitch(df, width=width).collect():
        got.setdefault(r.job_id, []).append((r.ord, r.start, r.end, r.text))
    for j, rows in jobs.items():
        assert sorted(got[j]) == sorted(fold(rows)), (j, rows)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 5, "a"), (4, 8, "b"), [(0, 5, "a"), (5, 8, "b")]), ((0, 5, "a"), (4.8, 8, "b"), [(0, 5, "a"), (4.8, 8, "b")]), ((0, 5, "a"), (4, 4.5, "b"), [(0, 5, "a b")]), ((0, 5, "a"), (4, None, "b"), [(0, 5, "a"), (5, None, "b")])],
)
def test_stitch(spark, a, b, want):
    df = spark.createDataFrame([(1, 0, *a), (1, 1, *b)], "job_id int, ord int, start string, end string, text string")
    assert [tuple(r) for r in stitch.stitch(df).orderBy("ord").select("start", "end", "text").collect()] == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "a")], "job_id int, ord int, start double, end double, text string")
    plan = stitch.stitch(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert stitch.stitch(df.limit(0)).count() == 0
