"""Chunks and size-bounded groups against plain loops over each job."""

import random

import pandas as pd
import pytest

from parlance.operators import chunk, scan


def chunk_job(pdf: pd.DataFrame, chunk_tokens: int, overlap: int) -> pd.DataFrame:
    """Chunks of one job's normalised rows."""
    limit, carry = max(1, chunk_tokens), max(0, min(overlap, chunk_tokens // 2))
    pdf = pdf.sort_values("pos")
    idx, body, speakers, starts, ends = (pdf[c].tolist() for c in ("idx", "text", "speaker", "start", "end"))
    size = [max(1, len(x) // 4) for x in body]
    job_id = pdf["job_id"].iloc[0]
    out: list[tuple] = []
    texts: list[str] = []
    held: list[int] = []
    tokens, speaker, start, end = 0, None, 0.0, 0.0

    def emit() -> None:
        who = {speakers[i] for i in held}
        out.append((job_id, len(out), " ".join(texts), speaker if len(who) == 1 else "multiple", start, end, list(held), [int(idx[i]) for i in held]))

    for i, (text, who) in enumerate(zip(body, speakers)):
        full = tokens + size[i] > limit
        turn = who != speaker and tokens >= limit // 2
        if held and (full or turn):
            emit()
            kept: list[int] = []
            total = 0
            for j in reversed(held):  # at least one row is carried over, whatever its size
                if kept and total + size[j] > carry:
                    break
                kept.append(j)
                total += size[j]
            held, tokens, speaker = kept[::-1], total, who
            texts = [body[j] for j in held]
            start, end = starts[held[0]], ends[held[-1]]
        if not held:
            start, speaker = starts[i], who if speaker is None else speaker
        texts.append(f"{who}: {text}" if who and who.lower() != "unknown" else text)
        held.append(i)
        tokens += size[i]
        end = ends[i]
    if held:
        emit()
    return pd.DataFrame(out, columns=["job_id", "chunk_id", "text", "speaker", "start", "end", "positions", "segment_ids"])


def group_job(sizes, most):
    group, used, out = 0, 0, []
    for n in sizes:
        if used and used + n > most:
            group, used = group + 1, 0
        used += n
        out.append(group)
    return out


def frame(spark, jobs):
    rows = [(j, i, i * 2, t, w, float(i), i + 0.5) for j, texts in jobs.items() for i, (w, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "job_id string, pos int, idx int, text string, speaker string, start double, end double").repartition(5)


def random_job(rng, n, people="ab", longest=60):
    return [(rng.choice([*people, "unknown"]), "x" * rng.choice([1, 5, rng.randint(1, longest), rng.randint(1, 4 * longest)])) for _ in range(n)]


@pytest.mark.parametrize("tokens,overlap", [(20, 5), (10, 100), (1, 0), (30, 0), (300, 50)])
def test_chunks_against_a_loop(spark, tokens, overlap):
    rng = random.Random(tokens)
    jobs = {"a": random_job(rng, 900), "b": random_job(rng, 1), "c": random_job(rng, 300, "a"), "d": random_job(rng, 200, "abcdef", 8), "e": random_job(rng, 150, "ab", 4000)}
    df = frame(spark, jobs)
    want = pd.concat(chunk_job(pdf, tokens, overlap) for _, pdf in df.toPandas().groupby("job_id"))
    got = chunk.chunk(df, tokens, overlap)
    assert got.dtypes == [("job_id", "string"), ("chunk_id", "int"), ("text", "string"), ("speaker", "string"), ("start", "double"), ("end", "double"), ("positions", "array<int>"), ("segment_ids", "array<int>")]
    rows = sorted((*r[:6], list(r.positions), list(r.segment_ids)) for r in got.collect())
    assert rows == sorted((*r[:6], list(r[6]), list(r[7])) for r in want.itertuples(index=False))


def test_chunk_rules(spark):
    def positions(texts, tokens, overlap):
        return [r.positions for r in chunk.chunk(frame(spark, {"j": texts}), tokens, overlap).orderBy("chunk_id").collect()]

    assert positions([("S", "x" * 40)] * 3, 10, 0) == [[0], [0, 1], [1, 2]]  # one row is carried over even without overlap
    assert positions([("A", "x" * 20), ("B", "x" * 16), ("B", "x" * 16), ("B", "x" * 16)], 20, 0) == [[0, 1, 2], [2, 3]]
    assert chunk.chunk(frame(spark, {"j": [("S", "x")]}).limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 7, 50, 3000])
def test_groups_against_a_loop(spark, most):
    rng = random.Random(most)
    jobs = {j: [("a", "x" * rng.choice([0, 0, 1, 2, rng.randint(0, 20), most + 1])) for _ in range(n)] for j, n in (("a", 1500), ("b", 1), ("c", 300))} | {"d": [("a", "")] * 5, "e": [("a", None)] * 3}
    got = {(r.job_id, r.idx): r.group for r in chunk.group_by_size(frame(spark, jobs), most).collect()}
    assert got == {(j, 2 * i): g for j, texts in jobs.items() for i, g in enumerate(group_job([len(t or "") for _, t in texts], most))}


def test_no_task_holds_a_job(spark):
    """A job with nearly all rows: no Python in the plan, and the rows of the job are dealt over the tasks."""
    jobs = {"hot": random_job(random.Random(1), 6000, "ab", 40), "b": random_job(random.Random(2), 20)}
    df = frame(spark, jobs)
    got = chunk.chunk(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    sized = scan.lookahead(df.selectExpr("job_id", "pos", "pos * 10 AS at"), 100, 1600, 100)
    per = {r.block: r["count"] for r in sized.where("job_id = 'hot'").groupBy("block").count().collect()}
    assert max(per.values()) < 200 and sum(per.values()) < 1.2 * 6000
