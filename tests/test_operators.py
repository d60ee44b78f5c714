"""Edge cases of the operators, with expected values worked out by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.functions import intent, text, vector
from parlance.functions.embed import hashing_embedder
from parlance.operators import align, chunk, evaluate, index, retrieve, stitch, store
from parlance.plans import pipelines
from parlance.sources import transcripts
from parlance.streaming import events as ev


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def speakers(spark, asr, ivl):
    a = spark.createDataFrame([(1, i, s, e, "t") for i, (s, e) in enumerate(asr)], "job_id int, ord bigint, start double, end double, text string")
    d = spark.createDataFrame([(1, i, s, e, w) for i, (s, e, w) in enumerate(ivl)], "job_id int, ord bigint, start double, end double, speaker string")
    return [r.speaker for r in align.assign_speakers(a, d).orderBy("ord").collect()]


def test_overlap_tie_takes_the_first(spark):
    assert speakers(spark, [(0.0, 4.0)], [(0.0, 2.0, "A"), (2.0, 4.0, "B")]) == ["A"]


def test_nearest_midpoint_without_overlap(spark):
    assert speakers(spark, [(10.0, 11.0)], [(0.0, 2.0, "A"), (2.0, 4.0, "B"), (20.0, 21.0, "C")]) == ["B"]


def test_no_intervals_and_null_times(spark):
    assert speakers(spark, [(0.0, 1.0), (None, 2.0)], []) == ["Unknown"]


def test_overlap_across_many_buckets(spark):
    assert speakers(spark, [(0.0, 1000.0)], [(0.0, 400.0, "A"), (400.0, 1000.0, "B")]) == ["B"]


def test_run_merge_text_and_gap(spark):
    r = spark.createDataFrame([(1, 0, "A", 0.0, 1.0, "x"), (1, 1, "A", 1.5, 2.0, ""), (1, 2, "A", 2.0, 3.0, "y"), (1, 3, "A", 3.6, 4.0, "z")], "job_id int, ord int, speaker string, start double, end double, text string")
    got = align.merge_runs(r).orderBy("run").collect()
    assert [(x.text, x.start, x.end) for x in got] == [("x  y", 0.0, 3.0), ("z", 3.6, 4.0)]


def test_windows(spark):
    r = spark.createDataFrame([(1, 10.0)], "job_id int, duration double")
    assert [(x.start, x.end) for x in stitch.windows(r, 4, 1).orderBy("n").collect()] == [(0, 4), (3, 7), (6, 10), (9, 10)]


def test_normalise(spark):
    raw = spark.createDataFrame([(1, 0, "real text", None, None, [10.5, 12.0]), (1, 1, "", "other", "x", None), (1, 2, "  ", None, None, None), (1, 3, "t", None, "oops", None)], "job_id int, idx int, text string, transcript string, start string, timestamp array<double>")
    got = chunk.normalise(raw).orderBy("pos").collect()
    assert [(r.idx, r.text, r.speaker, r.start, r.end) for r in got] == [(0, "real text", "unknown", 10.5, 12.0), (1, "other", "unknown", 0.0, 0.0), (3, "t", "unknown", 0.0, 0.0)]


def test_scalars(spark):
    assert [one(spark, text.token_estimate(F.lit(x))) for x in ("", "Hi", "word", "abcdefgh")] == [1, 1, 1, 2]
    assert one(spark, text.hms(F.lit(90061.9))) == "25:01:01"
    assert [one(spark, vector.relevance_pct(F.lit(x))) for x in (0.3, 1.4, -1.0, 0.875)] == [70, 0, None, 12]
    assert one(spark, text.strip(F.lit("　 a b \n"))) == "a b"
    assert one(spark, text.json_candidate(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.evaluation_text(F.lit("Ａ、b 。"))) == "Ab"
    assert one(spark, store.tail(F.array(*map(F.lit, [1, 2, 3])), 50)) == [1, 2, 3]


def test_intent(spark):
    for q, level in (("Summarize the meeting", "document"), ("who said that?", "segment"), ("要約して", "document"), ("誰が", "segment"), ("budget", "chunk"), ("", "chunk")):
        assert one(spark, intent.detect_intent(F.lit(q))) == level
    assert one(spark, intent.parse_level(F.lit("I think Segment"))) == "segment"


def test_mmr():
    q, v = np.array([1.0, 0, 0]), np.array([[0.1, 0.9, 0], [0.95, 0.05, 0], [0.5, 0.5, 0]])
    assert retrieve.mmr_order(q, v, 2, 0.7)[0] == 1
    assert sorted(retrieve.mmr_order(np.ones(3), np.eye(3), 10, 0.7)) == [0, 1, 2]
    assert 2 in retrieve.mmr_order(q, np.array([[1.0, 0, 0], [0.99, 0.01, 0], [0, 0, 1.0]]), 2, 0.1)


def test_source_fallback(spark):
    rows = spark.createDataFrame([(1, i, [1.0, 1.0, 1.0], [float(i == j) for j in range(3)]) for i in range(3)], "query_id bigint, pos bigint, answer array<double>, embedding array<double>")
    assert retrieve.select_sources(rows, 0.99).count() == 2


def test_word_error_rate():
    assert evaluate.edit_distance("a b c".split(), "a x c d".split()) == 2


def test_lockout():
    _, until, rows = ev.lock_state([(float(i), False) for i in range(6)], 0, 0.0)
    assert [r[1] for r in rows] == ["failed"] * 4 + ["locked", "rejected"] and until == 4 + 15 * 60
    assert ev.lock_state([(0.0, False), (1.0, True), (2.0, False)], 0, 0.0)[0] == 1


def test_snapshots(spark, tmp_path):
    for n in (3, 5):
        index.publish(spark.range(n), str(tmp_path / "index"), docs=n)
        assert index.current(spark, str(tmp_path / "index")).count() == n


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "segments")
    store.overwrite_partitions(spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "job_id int, idx int"), path)
    for _ in range(2):
        store.overwrite_partitions(spark.createDataFrame([(1, 0)], "job_id int, idx int"), path)
        assert sorted(map(tuple, spark.read.parquet(path).select("job_id", "idx").collect())) == [(1, 0), (2, 0)]


def test_json_shapes(spark, tmp_path):
    (tmp_path / "one.json").write_text('[{"start": 0, "end": 1, "text": "a"}]')
    (tmp_path / "two.json").write_text('{"segments": [{"start": 0, "end": 1, "text": "b"}, {"start": 1, "end": 2, "text": "c"}]}')
    got = transcripts.read_json(spark, str(tmp_path))
    assert sorted((r.job_id, r.idx, r.text) for r in got.collect()) == [("one", 0, "a"), ("two", 0, "b"), ("two", 1, "c")]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(u, float(k * 10), (k * 7 + u) % 5 == 0) for u in range(3) for k in range(12)], "user_id bigint, ts double, success boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ev.login_outcomes_stream(stream).writeStream.outputMode("append").format("memory").queryName("logins").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("logins").collect())) == sorted(map(tuple, ev.login_outcomes(rows).collect()))


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.sql("SELECT id % 2 AS user_id, timestamp_seconds(id * 60) AS ts FROM range(300)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ev.rate_limit(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user_id", 10)
    q = stream.writeStream.outputMode("update").format("memory").queryName("limits").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, ev.rate_limit(rows, "user_id", 10).collect()))


def test_answer_plan(spark):
    segments = spark.createDataFrame([(1, i, s, w, float(i), i + 1.0) for i, (s, w) in enumerate([("A", "the budget is tight"), ("B", "we ship on monday"), ("A", "")])], "job_id int, idx int, speaker string, text string, start double, end double")
    embed = hashing_embedder()
    docs = pipelines.build_index(segments, embed).cache()
    assert {(r.level, r.n) for r in docs.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()} == {("document", 1), ("segment", 2), ("chunk", 1)}
    asked = spark.createDataFrame([(7, "who said we ship on monday")], "query_id bigint, question string")
    got = pipelines.answer_candidates(docs, asked, embed).orderBy("rank").collect()
    assert got[0].id == "1_seg_1"
