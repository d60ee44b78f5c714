"""The stored index against a comparison with all rows, and the cells that it reads."""

import numpy as np
import pytest

from parlance.operators import vector_index


def brute(rows, q, k):
    q = np.array(q, float)
    out = []
    for i, v in rows:
        v = np.array(v, float)
        size = np.linalg.norm(q) * np.linalg.norm(v)
        out.append((round(1 - (float(q @ v) / size if size > 0 else 0.0), 9), i))
    return [(n + 1, i) for n, (d, i) in enumerate(sorted(out)[:k])]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id))
    return out


def test_clustered_vectors_read_few_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((40, 16)) * 10
    rows = [(i, (middles[i % 40] + rng.standard_normal(16) * 0.05).tolist()) for i in range(4000)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vector_index.build(docs, f"{tmp_path}/i", cells=40)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 4000, 97)], "query_id bigint, q array<double>")
    got, read = vector_index.search(spark, f"{tmp_path}/i", asked, 7)
    assert answers(got) == {i: brute(rows, rows[i][1], 7) for i in range(0, 4000, 97)}
    per = [r["count"] for r in read.groupBy("query_id").count().collect()]
    assert len(per) == 42 and np.mean(per) < 6  # of 40 cells
    assert read.count() == read.distinct().count()


def test_only_the_cells_of_a_question_are_listed(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((30, 8)) * 10
    rows = [(i, (middles[i % 30] + rng.standard_normal(8) * 0.01).tolist()) for i in range(3000)]
    vector_index.build(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), f"{tmp_path}/i", cells=30)
    asked = spark.createDataFrame([(5, rows[5][1])], "query_id bigint, q array<double>")
    routes = vector_index.route(asked, vector_index.cell_map(spark, f"{tmp_path}/i", None), 3, False)
    found = vector_index.meet(spark, f"{tmp_path}/i", routes, 3)
    scans = [n for n in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in n]
    assert any("cell" in n.split("PartitionFilters: [")[1].split("]")[0] for n in scans)
    assert routes.count() == 1 and len(found.collect()) == 3


@pytest.mark.parametrize("cells", [1, None])
def test_awkward_vectors(spark, tmp_path, cells):
    rng = np.random.default_rng(3)
    good = [(i, v) for i, v in enumerate(np.round(rng.standard_normal((300, 6)), 1).tolist())] + [(400 + i, [1.0] * 6) for i in range(150)] + [(600, [0.0] * 6), (601, [0.0] * 6)]
    bad = [(700, None), (701, []), (702, [1.0]), (703, [float("nan")] * 6), (704, [None] + [1.0] * 5), (705, [float("inf")] * 6)]
    docs = spark.createDataFrame([(i, v, ["x", None, "1"][i % 3]) for i, v in good + bad], "vec_id bigint, embedding array<double>, level string")
    vector_index.build(docs, f"{tmp_path}/i", level_col="level", cells=cells)
    questions = [(1, good[1][1]), (2, [1.0] * 6), (3, [0.0] * 6), (4, [-1.0] * 6), (5, None), (6, [2.0]), (7, [float("nan")] * 6)]
    asked = spark.createDataFrame(questions, "query_id bigint, q array<double>")
    for level, some, k in ((None, good, 9), ("x", [r for r in good if r[0] % 3 == 0], 1000), ("1", [r for r in good if r[0] % 3 == 2], 1), ("none", good, 200)):
        got, _ = vector_index.search(spark, f"{tmp_path}/i", asked, k, level)
        assert answers(got) == {i: brute(some, q, k) for i, q in questions[:4]}, (level, k)


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, q array<double>")
    for n, df in enumerate((docs, docs.limit(0))):
        vector_index.build(df, f"{tmp_path}/{n}")
        got, read = vector_index.search(spark, f"{tmp_path}/{n}", asked, 3)
        assert got.columns == ["query_id", "rank", "id", "distance", "relevance"] and got.count() == 0 and read.count() == 0
