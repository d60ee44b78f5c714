"""Unique names and code requests against loops."""

import random

import pytest

from parlance.operators.names import unique_names
from parlance.streaming import events as ev


def one_by_one(wanted, taken, longest=60):
    used, out = set(taken), {}
    for i, name in sorted(wanted):
        base = name[:longest]
        name, k = base, 0
        while name in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name)
        out[i] = name
    return out


def check(spark, wanted, taken):
    got = unique_names(spark.createDataFrame(wanted, "id bigint, name string").repartition(5), spark.createDataFrame([(n,) for n in taken], "name string")).collect()
    want = one_by_one(wanted, taken)
    assert {r.id: r.name for r in got} == want and len(got) == len(wanted)
    assert len({*want.values(), *taken}) == len(want) + len(set(taken))


def test_names_that_are_others_numbered_forms(spark):
    check(spark, [(1, "a"), (2, "a"), (3, "a_1")], [])
    check(spark, [(1, "a"), (2, "a_1"), (3, "a"), (4, "a_1"), (5, "a")], [])
    check(spark, [(1, "a_1_1"), (2, "a_1"), (3, "a"), (4, "a"), (5, "a_1"), (6, "a_1")], ["a", "a_2", "a_01"])
    check(spark, [], ["a"])


@pytest.mark.parametrize("seed", range(4))
def test_random_names(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a_1", "a_2", "a_3", "a_10", "a_1_1", "a_1_2", "a_01", "_1", "", "b\n", "b\n_1", "x" * 60, "x" * 70, "x" * 58 + "_1", "x" * 58] + [f"a_{k}" for k in range(4, 40, 1 + seed)]
    wanted = [(i, rng.choice(pool[: rng.choice([3, 8, len(pool)])])) for i in rng.sample(range(20_000), 500)]
    check(spark, wanted, [rng.choice([*pool, "a_5", "x" * 60 + "_1"]) for _ in range(rng.choice([0, 6]))])


def test_a_name_that_many_want(spark):
    check(spark, [(i, "user") for i in range(0, 12_000, 2)] + [(i, f"user_{i}") for i in range(1, 3000, 2)], ["user_7", "user_6000"])


def issued(times, cooldown=60.0):
    last, out = None, []
    for t in sorted(times):
        ok = last is None or t - last >= cooldown
        last = t if ok else last
        out.append((t, ok))
    return out


def test_refused_requests_do_not_count(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 30, 60, 90, 120)], "user_id int, ts double")
    assert [r.ts for r in ev.resend_allowed(df).where("allowed").orderBy("ts").collect()] == [0, 60, 120]


def test_requests_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, round(rng.uniform(0, 40_000 if u else 3000), 3)) for u in (None, 1, 2, 3) for _ in range(600)]
    rows += [(5, 100.0)] * 4
    want = sorted((str(u), *r) for u in {r[0] for r in rows} for r in issued([t for v, t in rows if v == u]))
    df = spark.createDataFrame(rows, "user_id int, ts double")
    assert sorted((str(r.user_id), r.ts, r.allowed) for r in ev.resend_allowed(df).collect()) == want
    rows.sort(key=lambda r: r[1])
    for k in range(3):
        spark.createDataFrame(rows[k * 900 : (k + 1) * 900], "user_id int, ts double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("user_id int, ts double").parquet(f"{tmp_path}/in")
        q = ev.resend_allowed_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((str(r.user_id), r.ts, r.allowed) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
