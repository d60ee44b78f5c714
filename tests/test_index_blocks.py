"""The stored index with questions in blocks, on vectors without clusters and with odd level names."""

import numpy as np
import pytest

from parlance.operators import nearest, vector_index


@pytest.mark.parametrize("several", [False, True])
def test_questions_in_blocks_and_levels(spark, tmp_path, several, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((2000, 6))
    v[1500:] = v[1499]  # copies, more than are asked for
    levels = ["it's", 'a "b"', "x\\y"]
    docs = spark.createDataFrame([(i, x, levels[i % 3]) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>, level string")
    vector_index.build(docs, f"{tmp_path}/i", level_col="level", cells=12)
    at = list(range(0, 2000, 25))
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in at], "query_id bigint, q array<double>")
    if several:
        monkeypatch.setattr(nearest, "BLOCK_BYTES", 10_000)
        assert len(list(nearest.blocks(asked, 7))) > 1
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    far = np.round(1 - unit[at] @ unit.T, 9)
    for level in (None, *levels):
        mine = np.array([i for i in range(2000) if level is None or levels[i % 3] == level])
        got, read = vector_index.search(spark, f"{tmp_path}/i", asked, 7, level)
        got = {(r.query_id, r["rank"]): r.id for r in got.collect()}
        assert got == {(q, n + 1): int(mine[j]) for x, q in enumerate(at) for n, j in enumerate(np.lexsort((mine, far[x, mine]))[:7])}
        assert {r.level for r in read.select("level").distinct().collect()} == {vector_index.ANY + x for x in ([level] if level else levels)}


def test_no_pair_is_a_row(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(rng.standard_normal((600, 8)).tolist())], "vec_id bigint, embedding array<double>")
    vector_index.build(docs, f"{tmp_path}/i", cells=5)
    asked = docs.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    routes = vector_index.route(asked, vector_index.cell_map(spark, f"{tmp_path}/i", None), 600, False)
    assert routes.count() == 60  # a question that goes to all five cells is one row
    found = vector_index.meet(spark, f"{tmp_path}/i", routes, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    assert found.count() == 240
