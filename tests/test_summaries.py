"""Map-reduce prompts, and edits inside stored JSON, against plain code."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import summarize
from parlance.sources.transcripts import patch_json


def test_every_segment_is_in_one_prompt_and_one_summary_is_left(spark):
    rng = random.Random(1)
    rows = [(j, i, rng.choice(["A", None]), float(i), i + 0.5, f"<{j}.{i}>" + "x" * rng.randint(0, 60)) for j, n in ((None, 3), ("a", 400), ("b", 1), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "job_id string, idx int, speaker string, start double, end double, text string")
    final, prompts = summarize.summarize(df, lambda p: p.withColumn("summary", F.concat(F.lit("s"), F.repeat(F.lit("y"), 49))), 200)
    assert sorted(str(r.job_id) for r in final.collect()) == ["None", "a", "b", "c"] and {r.summary for r in final.collect()} == {"s" + "y" * 49}
    got = prompts.collect()
    first = [r for r in got if r.level == 0]
    for j, i, who, a, b, text in rows:
        (r,) = [r for r in first if f"<{j}.{i}>" in r.prompt]
        assert f"[{who or '?'} {a}-{b}] {text}" in r.prompt and r.job_id == j
    assert all(sum(len(x[5]) for x in rows if f"<{x[0]}.{x[1]}>" in r.prompt) <= 200 for r in first)
    assert all(r.prompt.count("Summary:") <= 5 for r in got if r.level)
    levels = {(r.job_id, r.level): 0 for r in got}
    for r in got:
        levels[r.job_id, r.level] += 1
    assert levels["a", 0] > 60 and levels["a", max(n for j, n in levels if j == "a")] == 1 and levels["b", 1] == 1
    with pytest.raises(RuntimeError):
        summarize.summarize(df, lambda p: p.withColumn("summary", F.lit("z" * 150)), 200)
    assert summarize.summarize(df.limit(0), lambda p: p.withColumn("summary", F.lit("")), 200)[0].count() == 0


def test_patches_keep_the_rest_of_a_document(spark):
    rng = random.Random(2)
    docs, edits, want = [], [], {}
    for j in range(60):
        segments = [{"start": i * 1.5, "speaker": rng.choice(["A", None]), "text": f't"{i}\n', "words": [{"w": "é", "n": [None, {}, 1e-7]}], **({"x": {"text": "kept"}} if i % 2 else {})} for i in range(rng.randint(0, 6))]
        doc = segments if j % 2 else {"segments": segments, "input_file": "a\\b", "n": 12345678901234567890, "meta": {"segments": [1]}}
        docs.append((j, json.dumps(doc, ensure_ascii=bool(j % 3)), "other"))
        for i in rng.sample(range(8), rng.randint(0, 4)):
            who, text = rng.choice([None, "Bob", '"']), rng.choice([None, "", "neu\\ \n€"])
            edits.append((j, i, who, text))
            if i < len(segments):
                segments[i] |= {"speaker": who, "text": text}
        want[j] = doc
    got = patch_json(spark.createDataFrame(docs, "job_id int, json string, more string"), spark.createDataFrame(edits, "job_id int, idx int, speaker string, text string")).collect()
    assert {r.job_id: json.loads(r.json) for r in got} == want and {r.more for r in got} == {"other"}
    edit = spark.createDataFrame([(1, 0, "a", "b")], "job_id int, idx int, speaker string, text string")
    for bad in ('{"text": "x"}', '"x"', '{"segments": 3}'):
        with pytest.raises(Exception, match="neither a list"):
            patch_json(spark.createDataFrame([(1, bad)], "job_id int, json string"), edit).collect()
