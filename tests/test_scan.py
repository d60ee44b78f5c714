"""Running values and successor paths against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators.scan import orbit, running


def test_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), k, rng.choice([None, 1, 2, 5]), rng.choice([None, *"xyz"])) for k in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "job string, idx int, n int, who string")
    got = running(df, ["job"], F.floor(F.col("idx") / 50), ["idx"], {"before": F.col("n"), "place": F.lit(1)}, {"last": F.when(F.col("who").isNotNull(), F.struct("idx", "who"))}).collect()
    assert len(got) == len(rows)
    for r in got:
        past = sorted((x for x in rows if x[0] == r.job and x[1] < r.idx), key=lambda x: x[1])
        assert r.before == sum(x[2] or 0 for x in past) and r.place == len(past)
        assert (r["last"] and r["last"].who) == next((x[3] for x in reversed(past) if x[3]), None)


@pytest.mark.parametrize("sizes,step", [({"a": 1, None: 30, "c": 256}, 9), ({"a": 5000, "b": 700, None: 257}, 3), ({"a": 9000}, 900)])
def test_orbit(spark, sizes, step):
    rng = random.Random(2)
    to = {j: [i + rng.randint(1, step) for i in range(n)] for j, n in sizes.items()}
    df = spark.createDataFrame([(j, i, x) for j, xs in to.items() for i, x in enumerate(xs)], "job string, pos int, next int").repartition(7)
    want = []
    for j, xs in to.items():
        at = 0
        while at < len(xs):
            want.append((j, at))
            at = xs[at]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, orbit(df, ["job"]).collect()), key=key) == sorted(want, key=key)


def test_a_long_path_is_spread_over_tasks(spark):
    """One job of 20,000 places: no task of the plan gets more than a few blocks of it."""
    steps = spark.range(20_000).select(F.when(F.col("id") >= 0, "hot").alias("job"), F.col("id").alias("pos"), (F.col("id") + 1).alias("next")).repartition(8)
    assert orbit(steps, ["job"]).count() == 20_000
    rows = running(steps, ["job"], F.floor(F.col("pos") / 500), ["pos"], {"n": F.lit(1)})
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 20_000 * 0.7 and len(sizes) > 1
