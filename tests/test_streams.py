"""Streams with state: several batches and a restart give what the batch form gives."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.streaming import events as ev
from parlance.streaming import stateful


@pytest.fixture(scope="module")
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.with_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def feed(spark, tmp_path, rows, schema, make, mode, cuts):
    """Write rows in parts; after each, start the query anew (it goes on from its checkpoint). Returns the rows of each run."""
    found = []

    def keep(batch, n):
        found.extend(batch.collect())

    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return found


def test_progress_with_logs(store, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice("xyz"), k / 10, rng.choice([None, "", f"line {k}", f"line {k}"])) for k in range(400)]
    schema = "job_id string, seq bigint, stage string, progress double, message string"
    got = feed(store, tmp_path, rows, schema, stateful.latest_progress_stream, "update", [5, 150, 300])
    last = {}
    for r in got:
        last[r.job_id] = r
    want = {r.job_id: r for r in ev.latest_progress(store.createDataFrame(rows, schema)).collect()}
    assert {j: tuple(r) for j, r in last.items()} == {j: tuple(r) for j, r in want.items()}
    for j, r in want.items():
        lines = [m for i, _, _, _, m in rows if i == j and m]
        assert r.logs == lines[-50:] and len(lines) > 50


def answers(rng):
    """Events of answers: well formed, broken off, with kinds out of place, and with many tokens."""
    rows = []
    for m in range(30):
        at, seq = 1000.0 + rng.randint(0, 50), 0
        kinds = ["sources", *["token"] * rng.choice([0, 1, 5, 40]), *rng.choice([["done"], ["error"], [], ["retrieval_level_note", "done"], ["done", "token"]])]
        if m % 9 == 4:
            kinds = kinds[1:]
        for kind in kinds:
            at += rng.choice([0.0, 0.01, 0.2, 0.5])
            rows.append((m, seq, at, kind, {"token": f"t{seq} ", "done": rng.choice([f"answer {m}", None])}.get(kind)))
            seq += 1
    return sorted(rows, key=lambda r: (r[2], r[0], r[1]))


def test_answers_flush_end_and_are_checked(store, tmp_path):
    rows = answers(random.Random(2))
    rows.append((99, 0, 100_000.0, "sources", None))  # moves the watermark, so that silent answers end
    schema = "message_id bigint, seq bigint, at double, kind string, data string"
    with_ts = lambda df: df.withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("bigint")))
    make = lambda df: stateful.answer_stream(with_ts(df), most=7, after_s=1.0)
    got = feed(store, tmp_path, rows, schema, make, "append", [100, 101, 250, len(rows) - 1])
    batch = with_ts(store.createDataFrame(rows, schema)).where("message_id <> 99")
    flushes = {}
    for r in ev.token_flushes(batch.where("kind = 'token'"), most=7).join(batch, ["message_id", "seq"]).collect():
        flushes.setdefault((r.message_id, r.flush), []).append((r.seq, r.data))
    ends = {r.message_id: r.seq for r in batch.where("kind IN ('done', 'error')").collect()}
    for r in (r for r in got if r.event == "flush"):
        assert r.text == "".join(d for _, d in sorted(flushes[r.message_id, r.flush])) and r.seq == max(flushes[r.message_id, r.flush])[0]
    # The last flush of an answer may be cut short by its end.
    full = {k for k, v in flushes.items() if max(v)[0] < ends.get(k[0], 10**9) and (k[0], k[1] + 1) in flushes and (k[0], k[1] + 1) != max(f for f in flushes if f[0] == k[0])}
    assert full <= {(r.message_id, r.flush) for r in got if r.event == "flush"}
    final = {r.message_id: (r.text, r.status) for r in got if r.event == "final"}
    first_end = batch.join(batch.where("kind IN ('done', 'error')").groupBy("message_id").agg(F.min("seq").alias("end")), "message_id", "left").where("end IS NULL OR seq <= end")
    assert final == {r.message_id: (r.content, r.status) for r in ev.final_messages(first_end).collect()} and {s for _, s in final.values()} == {"completed", "failed", "stopped"}
    wrong = {(r.message_id, r.seq) for r in got if r.event == "misplaced"}
    assert wrong == {(r.message_id, r.seq) for r in ev.protocol_errors(batch.select("message_id", "seq", "kind")).collect()} and wrong


def test_token_flushes_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, at = [], {m: 0.0 for m in range(4)}
    for k in range(300):
        m = rng.randrange(4)
        at[m] += rng.choice([0.0, 0.1, 0.4])
        rows.append((m, k, at[m], f"t{k} "))
    schema = "message_id bigint, seq bigint, at double, token string"
    with_ts = lambda df: df.withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("bigint")))
    got = feed(spark, tmp_path, rows, schema, lambda df: ev.token_flushes_stream(with_ts(df), most=9), "append", [50, 51, 200])
    want = {}
    for r in ev.token_flushes(with_ts(spark.createDataFrame(rows, schema)), most=9).collect():
        want.setdefault((r.message_id, r.flush), []).append(r.seq)
    assert len(got) >= len(want) - 4
    assert all(r.text == "".join(f"t{s} " for s in sorted(want[r.message_id, r.flush])) and r.seq == max(want[r.message_id, r.flush]) for r in got)
