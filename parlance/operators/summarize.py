"""Summaries of long transcripts in rounds: parts that fit a budget are summed up, then groups of summaries, until one prompt is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.chunk import group_by_size
from parlance.operators.index import ordered_join
from parlance.operators.lineage import stored

#: What a model is asked for a part (number, of how many, request, lines) and for summaries (request, summaries).
PART = (
    "Summarize the following section (%d/%d) of a meeting transcript. Focus on key points, decisions, and action items.\n\n"
    "User request: %s\n\nTranscript section:\n%s\n\nSummary:"
)
WHOLE = (
    "The following are summaries of different sections of a meeting transcript. Combine them into a single, coherent summary that addresses the user's request.\n\n"
    "User request: %s\n\nSection summaries:\n%s\n\nCombined summary:"
)
REQUEST = "Summarize this meeting."

#: From (job_id, level, n, prompt) to (job_id, level, n, summary).
Model = Callable[[DataFrame], DataFrame]


def line(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("?"))


def map_prompts(segments: DataFrame, most: int = 3000, request: str = REQUEST) -> DataFrame:
    """(job_id, level, n, prompt) of the first round: consecutive segments (job_id, idx, speaker, start, end, text) with `most` characters of text a prompt; each segment is in one."""
    rows = stored(segments.select("job_id", "idx", F.format_string("[%s %s-%s] %s", line("speaker"), line("start"), line("end"), F.coalesce("text", F.lit(""))).alias("line"), "text"))
    groups = group_by_size(rows, most)
    a, b = rows.alias("a"), groups.alias("b")
    met = a.join(b, F.col("a.job_id").eqNullSafe(F.col("b.job_id")) & (F.col("a.idx") == F.col("b.idx"))).select("a.job_id", "a.idx", "line", F.col("b.group").alias("n"))
    parts = stored(met.groupBy("job_id", "n").agg(ordered_join(F.col("line"), F.col("idx"), "\n").alias("lines")))
    a, b = parts.alias("a"), parts.groupBy("job_id").agg(F.max("n").alias("last")).alias("b")
    return a.join(b, F.col("a.job_id").eqNullSafe(F.col("b.job_id"))).select("a.job_id", F.lit(0).alias("level"), "n", F.format_string(PART, F.col("n") + 1, F.col("last") + 1, F.lit(request), "lines").alias("prompt"))


def reduce_prompts(summaries: DataFrame, level: int, most: int = 3000, request: str = REQUEST) -> DataFrame:
    """(job_id, level, n, prompt) from summaries (job_id, n, summary): as many in order as have `most` characters together, with numbers that go on through the job."""
    texts = stored(summaries.select("job_id", F.col("n").alias("idx"), F.coalesce("summary", F.lit("")).alias("text")))
    groups = group_by_size(texts, most)
    a, b = texts.alias("a"), groups.alias("b")
    met = a.join(b, F.col("a.job_id").eqNullSafe(F.col("b.job_id")) & (F.col("a.idx") == F.col("b.idx")))
    said = F.format_string("Section %d Summary:\n%s", F.col("a.idx") + 1, "a.text")
    parts = met.select("a.job_id", F.col("a.idx").alias("idx"), F.col("b.group").alias("n"), said.alias("text")).groupBy("job_id", "n").agg(ordered_join(F.col("text"), F.col("idx"), "\n\n---\n\n").alias("all"))
    return parts.select("job_id", F.lit(level).alias("level"), "n", F.format_string(WHOLE, F.lit(request), "all").alias("prompt"))


def summarize(segments: DataFrame, model: Model, most: int = 3000, request: str = REQUEST, max_rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """(job_id, summary) of each job, and the prompts of all rounds. Rounds go on while a job has more than one prompt; a job
    with one is finished. Summaries that don't get shorter than half the budget can't be brought together, which is an error."""
    prompts = stored(map_prompts(segments, most, request))
    asked, finished, level = prompts, None, 0
    while True:
        answers = stored(model(prompts).select("job_id", "level", "n", "summary"))
        if level:
            alone = answers.groupBy("job_id").agg(F.count(F.lit(1)).alias("k"))
            a, b = answers.alias("a"), alone.alias("b")
            answers = stored(a.join(b, F.col("a.job_id").eqNullSafe(F.col("b.job_id"))).select("a.*", "k"))
            done = answers.where("k = 1").select("job_id", "summary")
            finished = done if finished is None else finished.unionByName(done)
            answers = stored(answers.where("k > 1").drop("k"))
        count = answers.count()
        if not count:
            return finished if finished is not None else answers.select("job_id", "summary"), asked
        level += 1
        prompts = stored(reduce_prompts(answers, level, most, request))
        if level > max_rounds or (level > 1 and prompts.count() >= count):
            raise RuntimeError("summaries are too long to be brought together")
        asked = asked.unionByName(prompts)
