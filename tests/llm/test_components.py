"""Components against brute force, and the tasks that they cost."""

import random

import pytest

from parlance.llm.components import components


def tasks_of(spark, group, work):
    """What `work` returns, and the tasks that its jobs ran."""
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 20
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(edges):
    root = {v: v for e in edges for v in e}
    for a, b in edges:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {v: new if r == old else r for v, r in root.items()}
    return root


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    random.seed(seed)
    edges = [(a, b) for a, b in ((random.randrange(300), random.randrange(300)) for _ in range(130)) if a != b]
    got = components(spark.createDataFrame([*edges, edges[0][::-1], (7, 7)], "a bigint, b bigint")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == brute(edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stars_need_no_round(spark, many_partitions):
    """A graph that is stars already is recognised; there were 534 tasks before, two rounds that change nothing."""
    edges = spark.createDataFrame([(k, k // 10 * 10) for k in range(200)], "a bigint, b bigint").repartition(4)
    roots, tasks = tasks_of(spark, "stars", lambda: components(edges))
    assert {r.node: r.root for r in roots.collect()} == {k: k // 10 * 10 for k in range(200)}
    assert tasks <= 5 * many_partitions


def test_rounds_take_few_shuffles(spark, many_partitions):
    """Chains of three take one round, and no other to see that it was the last."""
    rows = [(k + 1, k) for k in range(200) if k % 3 < 2]
    edges = spark.createDataFrame(rows, "a bigint, b bigint").repartition(4)
    roots, tasks = tasks_of(spark, "chains", lambda: components(edges))
    assert {r.node: r.root for r in roots.collect()} == brute(rows)
    assert tasks <= 14 * many_partitions
