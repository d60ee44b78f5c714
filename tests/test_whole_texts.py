"""Queries over whole texts, where a cut or altered text gives other results."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from parlance.functions.text import iso_utc
from parlance.operators.evaluate import common_length, edit_distance
from parlance.plans.queries import QUERIES
from parlance.sources.transcripts import speaker_prefix


def conversations(spark, tmp_path, texts):
    """A folder of the tables with one conversation, a turn for each text."""
    rows = [(1, k, "user", x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def table(a, b):
    """Edit distance and longest common subsequence by the plain recurrence."""
    far, same = list(range(len(b) + 1)), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row, length = [i], [0]
        for j, y in enumerate(b, 1):
            row.append(min(far[j] + 1, row[-1] + 1, far[j - 1] + (x != y)))
            length.append(max(same[j], length[-1], same[j - 1] + (x == y)))
        far, same = row, length
    return far[-1], same[-1]


def test_distances_against_the_recurrence():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abé日"[: rng.randint(1, 4)]) for _ in range(rng.choice([0, 1, 5, 60, 150]))) for _ in range(2))
        if rng.random() < 0.5:
            b = "".join(rng.choice([x, x, x, "", "b" + x]) for x in a)
        assert (edit_distance(a, b), common_length(a, b)) == table(a, b)
        assert edit_distance(list(a), list(b)) == table(a, b)[0]
    began = time.time()
    a = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    assert 0 < edit_distance(a, a[7:15_000] + a[15_100:]) <= 107 and time.time() - began < 30


def test_transcript_quality_whole(spark, tmp_path):
    for k, (a, b) in enumerate([("same words " * 20 + "the end é", "same words, " * 20 + "another end ö"), ("日本、 語。", "日本 誤 り"), ("", "x y"), ("a b", ""), ("", "！"), ("ＡＢＣ １", "ABC 1!"), ("ｶﾞ", "ガ")]):
        r = QUERIES["transcript_quality_whole"](spark, conversations(spark, tmp_path / str(k), [a, b])).first()
        x, y = (re.sub("[。、！？,.!?]", "", unicodedata.normalize("NFKC", z)) for z in (a, b))
        one, two, c, d = set(x.split()), set(y.split()), re.sub(r"\s+", "", x), re.sub(r"\s+", "", y)
        precision, recall = (len(one & two) / len(z) if z else 0.0 for z in (two, one))
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        distance, same = table(c, d)
        want = (distance / max(1, len(c)), 2 * same / (len(c) + len(d)) if c or d else 1.0, table(x.split(), y.split())[0] / max(1, len(x.split())), precision, recall, f1)
        assert (r.reference_length, r.hypothesis_length, r.distance) == (len(c), len(d), distance)
        assert [r.cer, r.ratio, r.wer, r.precision, r.recall, r.f1] == [round(z, 6) for z in want]


def test_prefixes_of_awkward_texts(spark):
    cases = [(None, "Ann: hello\rthere", ("Ann", "hello\rthere")), (None, "\t A b\t:\u00a0 x\u2028y \n", ("A b", "x\u2028y")), (None, "a\nb: c", ("a\nb", "c")), (None, "a: b\nc", (None, "a: b\nc")), (None, " : x", (None, ": x"))]
    cases += [("S", " Ann: x ", ("S", "Ann: x")), (None, None, (None, "")), (None, "x" * 41 + ": y", (None, "x" * 41 + ": y")), (None, "Ann:", ("Ann", "")), (None, "A\x85B: z\x1c", ("A\x85B", "z"))]
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(cases)], "k int, speaker string, text string")
    assert [(r.speaker, r.text) for r in speaker_prefix(df).orderBy("k").collect()] == [w for _, _, w in cases]
    for s, t, w in cases:  # as Python's own patterns have it
        m = re.match(r"^\s*([A-Za-z0-9_\-\s]{1,40}):\s*(.*)$", (t or "").strip())
        assert w == ((m[1].strip(), m[2].strip()) if s is None and m and m[1].strip() else (s, (t or "").strip()))


def test_times_keep_microseconds(spark):
    row = spark.sql("SELECT timestamp'2026-03-04 03:04:05.123456' AS a, timestamp'2026-03-04 03:04:05' AS b, timestamp'2026-03-04 03:04:05.5' AS c").select(*[iso_utc(F.col(x)) for x in "abc"]).first()
    assert tuple(row) == ("2026-03-04T03:04:05.123456+00:00", "2026-03-04T03:04:05+00:00", "2026-03-04T03:04:05.500000+00:00")


def test_whole_texts_of_segments(spark, tmp_path):
    texts = ["first " * 30 + "end", "second\nline " * 20 + "end", "third " * 30 + "end"]
    d = conversations(spark, tmp_path, texts)
    merged = sorted(QUERIES["speaker_run_merge_whole"](spark, d).collect(), key=lambda r: r.run)
    assert " ".join(r.text for r in merged) == " ".join(texts)
    named = {r.turn: (r.speaker, r.text) for r in QUERIES["speaker_prefix_whole"](spark, d).collect()}
    assert named == {0: ("Speaker 0", texts[0]), 1: ("user", texts[1]), 2: ("Speaker 2", texts[2])}


def test_intent_of_whole_items(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 40 + "main points")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES["intent_levels_whole"](spark, str(tmp_path)).first().level == "document"
