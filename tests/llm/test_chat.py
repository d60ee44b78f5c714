"""Chat transcripts against a plain fold, and exact round trips through the template."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parlance.llm.chat import Template, escape, loss_texts, reconstruct, render, turns, unescape
from parlance.llm.queries import queries

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "\\", "\\\\", " ", "\n", "é", "<", "[", "s>", "/", "$1", "ok", "𝄞", ""]
junk = lambda rng: "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))


def fold(events):
    """Final (role, text) of each conversation, event by event as the docstring says."""
    logs = defaultdict(lambda: defaultdict(set))
    for conv, seq, message, kind, role, text in events:
        logs[conv][message].add((seq, kind, role or "", text or ""))
    out = {}
    for conv, messages in logs.items():
        final = []
        for key, log in messages.items():
            resets = [(s, t) for s, k, _, t in log if k in ("edit", "regenerate")]
            at, said = max(resets, default=(None, ""))
            rest = sorted({(s, t) for s, k, _, t in log if k not in ("edit", "regenerate") and (at is None or s > at)})
            opens = [(s, r) for s, k, r, _ in log if k == "open"]
            opened, role = min(opens) if opens else (min(s for s, *_ in log), "")
            final.append((opened, key, role, said + "".join(t for _, t in rest), at))
        final.sort()
        out[conv] = [(r, t) for n, (o, _, r, t, _) in enumerate(final) if not any(x[4] is not None and x[4] >= o for x in final[:n])]
    return {c: m for c, m in out.items() if m}


def random_log(rng, n):
    rows = []
    for _ in range(n):
        kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"])
        rows.append((rng.choice([None, *range(40)]), rng.randrange(12), rng.randrange(5), kind, rng.choice([None, "user", "assistant", "system", junk(rng)]), rng.choice([None, junk(rng)])))
    return rows + rng.sample(rows, n // 5)


@pytest.mark.parametrize("seed", range(3))
def test_logs_fold_into_final_messages(spark, seed):
    rows = random_log(random.Random(seed), 900)
    log = spark.createDataFrame(rows, "conv_id int, seq int, message int, kind string, role string, text string").withColumn("at", F.lit("clash")).withColumn("open", F.lit("clash"))
    want = fold(rows)
    chats = render(reconstruct(log))
    got = chats.select("*", turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted").cast("binary"), F.col("loss_spans")).alias("loss")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        assert r.n_turns == len(r.turns) and r.loss == [t for role, t in want[r.conv_id] if role == "assistant"]
        raw = r.formatted.encode()
        for s in r.loss_spans:
            assert r.formatted[s.start : s.start + s.length].encode() == raw[s.byte_start : s.byte_start + s.byte_length]
    assert render(reconstruct(log.limit(0))).count() == 0


def test_regenerating_drops_what_followed(spark):
    rows = [(1, 0, "a", "open", "user", "hi"), (1, 1, "b", "open", "assistant", "draft"), (1, 2, "c", "open", "user", "more"), (1, 3, "b", "regenerate", None, None), (1, 4, "b", "delta", None, "fi"), (1, 5, "b", "delta", None, "nal"), (1, 6, "d", "open", "user", "thx")]
    rows += [(1, 7, "d", "edit", None, "thanks"), (1, 4, "b", "delta", None, "fi")]
    got = render(reconstruct(spark.createDataFrame(rows, "conv_id int, seq int, message string, kind string, role string, text string"))).collect()
    assert [r.formatted for r in got] == ["<s>[INST] hi </s><s>[/INST] final </s><s>[INST] thanks </s>"]


def test_escaping_is_undone(spark):
    rng = random.Random(9)
    texts = [junk(rng) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = Template()
    got = df.select("text", escape(F.col("text"), t).alias("out"), unescape(escape(F.col("text"), t), t).alias("back")).collect()
    assert all(r.back == r.text and not re.search(r"(?<!\\)(<s>|</s>|\[/?INST\]|\[SYS\]|\[/?ROLE\])", r.out) for r in got)


def test_other_templates(spark):
    t = Template("<|im|>", "<|/im|>", (("user", "{U}"), ("bot", "{B}")), ("{R}", "{/R}"), ("bot", "tool"))
    rows = [(1, k, k, "open", r, x) for k, (r, x) in enumerate([("user", "{U} <|im|> \\"), ("bot", "<|/im|>"), ("tool", ""), ("x {/R} ", "{B}")])]
    chats = render(reconstruct(spark.createDataFrame(rows, "conv_id int, seq int, message int, kind string, role string, text string")), t)
    (r,) = chats.select(turns(F.col("formatted"), t).alias("turns"), loss_texts(F.col("formatted").cast("binary"), F.col("loss_spans"), t).alias("loss")).collect()
    assert [tuple(x) for x in r.turns] == [(x[4], x[5]) for x in rows] and r.loss == ["<|/im|>", ""]
    for bad in (Template("<s>", "<s>x"), Template("< s>"), Template("ab", "ba"), Template("", "x")):
        with pytest.raises(ValueError):
            bad.controls()


def test_query_on_awkward_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, -1, *range(20)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "tool", "[ROLE] "]), rng.choice([None, "", "same", junk(rng), "x" * 70_000]), "clash") for _ in range(600)]
    rows += [(77, k, "assistant", f"part {k} \\</s>", "clash") for k in range(700)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copy string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries()["op13_chat_format"](spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list)
    for c, turn, role, text, _ in [*rows, (-1, 0, "user", said, ""), (-1, 1, "assistant", said, "")]:
        convs[c].append((turn is not None, turn, role is not None, role, text is not None, text))
    assert set(got) == set(convs)
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, parts in convs.items():
        parts.sort(key=lambda p: tuple(x if x is not None else "" for x in (p[0], p[1] or 0, p[2], p[3], p[4], p[5])))
        pairs = [(p[3] or "", p[5] or "") for p in parts]
        loss = "".join(t for r, t in pairs if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(pairs), hexed("".join(f"{a}\n{b}\n" for a, b in pairs)), len(loss), hexed(loss))
        assert r.formatted_chars > sum(len(t) for _, t in pairs)
    spark.createDataFrame(rows[:0], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.n_turns for r in queries()["op13_chat_format"](spark, f"{tmp_path}/none").collect()] == [2]
