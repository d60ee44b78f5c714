"""Nearest rows by matrix products, against all pairs."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from parlance.operators import nearest, retrieve


def far(q, v):
    """The distance as the SQL takes it; None where there is none."""
    if q is None or v is None or None in q or None in v or len(q) != len(v):
        return None
    dot = lambda a, b: sum((float(x) * float(y) for x, y in zip(a, b)), 0.0)
    size = math.sqrt(dot(q, q)) * math.sqrt(dot(v, v))
    if size == 0:
        return 1.0
    out = 1 - dot(q, v) / size if not math.isinf(size) or math.isfinite(dot(q, v)) else math.nan
    return out if math.isnan(out) else float(Decimal(repr(out)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def brute(rows, q, k):
    key = lambda x: (x[0] is None, x[0] is not None and math.isnan(x[0]), 0.0 if x[0] is None or math.isnan(x[0]) else x[0], x[1])
    return [(n + 1, i) for n, (_, i) in enumerate(sorted(((far(q, v), i) for i, v in rows), key=key)[:k])]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id))
    return out


@pytest.fixture
def awkward():
    rng = np.random.default_rng(5)
    good = np.round(rng.standard_normal((300, 6)), 1).tolist() + [[1.0] * 6] * 60 + [[0.0] * 6] * 4
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0], [None] + [1.0] * 5, [nan] * 6, [inf, 1, 1, 1, 1, 1], [1e200, 1.0, 0, 0, 0, 0], [1e-200] * 6, [1e-160, 0, 0, 0, 0, 0], [1.0] * 7, [1.0, None]]
    return [[float(x) if x is not None else None for x in v] if v is not None else None for v in good + bad]


@pytest.mark.parametrize("k", [1, 9, 371, 1000])
def test_awkward_vectors(spark, awkward, k, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 7)
    rows = list(enumerate(awkward))
    asked = [rows[n] for n in (0, 5, 301, 361, *range(364, len(rows)))]
    docs, queries = spark.createDataFrame(rows, "id bigint, embedding array<double>"), spark.createDataFrame(asked, "query_id bigint, q array<double>")
    got = answers(nearest.nearest(docs, queries, k))
    assert got == {i: brute(rows, q, k) for i, q in asked}


def test_rows_without_a_distance_come_last(spark):
    docs = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0])], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "query_id bigint, q array<float>")
    got = retrieve.knn(docs, asked, 3).orderBy("rank").collect()
    assert [(r.rank, r.id, r.distance is None, r.relevance is None) for r in got] == [(1, 2, False, False), (2, 3, False, False), (3, 1, True, True)]


def test_blocks_texts_as_ids_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    some = rng.standard_normal((50, 4)).tolist()
    rows = [(f"r{i}é", some[i % 50]) for i in range(900)]
    asked = [(f"q{i}", some[i]) for i in range(40)]
    docs, queries = spark.createDataFrame(rows, "id string, embedding array<double>"), spark.createDataFrame(asked, "query_id string, q array<double>")
    want = {i: brute(rows, q, 20) for i, q in asked}
    assert answers(nearest.nearest(docs, queries, 20)) == want
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 9000)
    assert len(list(nearest.blocks(queries, 20))) == 3
    assert answers(nearest.nearest(docs, queries, 20)) == want
    assert nearest.nearest(docs.limit(0), queries, 3).count() == 0 and nearest.nearest(docs, queries.limit(0), 3).count() == 0


def test_distances_half_between_billionths():
    values = np.array([0.5e-9, 1.4999999995, 0.1234567895, 0.1234567885, -2e-16, 1.9999999999999998, 0.0, np.nan])
    want = [float(Decimal(repr(float(v))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for v in values[:-1]]
    assert (nearest.nine(values)[:-1] / 1e9).tolist() == want and np.isinf(nearest.nine(values)[-1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_is_a_row(spark):
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((3000, 8)).tolist())], "vec_id bigint, embedding array<double>").coalesce(1)
    asked = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    found = retrieve.knn(rows, asked, 5)
    assert "MapInArrow" in plan(found) and "NestedLoopJoin" not in plan(found) and "Cartesian" not in plan(found)
    all_ = [(r.vec_id, r.embedding) for r in rows.collect()]
    got = answers(found)
    assert len(got) == 300 and all(got[i] == brute(all_, all_[i][1], 5) for i in range(0, 3000, 500))
    for metric in ("ip", "l2sq"):
        assert retrieve.knn(rows, asked.where("query_id < 100"), 5, metric).count() == 50


def test_a_level_without_rows_falls_back_to_all(spark):
    rng = np.random.default_rng(10)
    all_ = list(enumerate(rng.standard_normal((800, 5)).tolist()))
    docs = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in all_], "vec_id bigint, embedding array<double>, level string")
    asked = docs.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    for level, some in (("none", all_), ("b", all_[1::2]), (None, all_)):
        found = retrieve.knn(retrieve.with_level_fallback(docs, level), asked, 5)
        assert plan(found).split("Initial Plan")[0].count("NestedLoopJoin") == (level is not None)  # only the level's count meets the rows
        got = answers(found)
        assert got == {i: brute(some, v, 5) for i, v in all_[::10]}


def test_diverse_selection_of_the_recalled(spark):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((1000, 6))
    docs = spark.createDataFrame(list(enumerate(v.tolist())), "id bigint, embedding array<double>")
    asked = docs.where("id % 25 = 0").selectExpr("id AS query_id", "embedding AS q")
    recalled = retrieve.knn(docs, asked, 30, id_col="id")
    rows = recalled.join(docs, "id").join(asked, "query_id").withColumn("pos", recalled["rank"] - 1)
    chosen = retrieve.mmr(rows, 4)
    assert "NestedLoopJoin" not in plan(chosen)
    got, all_ = {(r.query_id, r["rank"]): r.pos for r in chosen.collect()}, list(enumerate(v.tolist()))
    for q in range(0, 1000, 25):
        near = [i for _, i in brute(all_, all_[q][1], 30)]
        assert [got[q, n] for n in range(1, 5)] == retrieve.mmr_order(v[q], v[near], 4, 0.7)


def test_of_very_many_copies_k_meet_the_questions(monkeypatch):
    import pyarrow as pa

    x = np.repeat(np.array([[1.0, 2.0], [0.0, 1.0]]), [3000, 5], axis=0)
    column = pa.array(x.tolist(), pa.list_(pa.float64()))
    met = []
    keep = nearest.Best.meet
    monkeypatch.setattr(nearest.Best, "meet", lambda self, ids, rows, some: (met.append(len(ids)), keep(self, ids, rows, some)))
    best = nearest.Best(nearest.vectors(x[::100]), 7)
    best.add(pa.array(range(3005, 0, -1)), column, np.arange(3005))
    q, far, ids = best.merge()
    assert met == [12] and q.tolist() == np.repeat(np.arange(31), 7).tolist()
    assert ids.to_pylist() == [*range(6, 13)] * 30 + [1, 2, 3, 4, 5, 6, 7] and np.abs(far[:210]).max() < 1e-15
