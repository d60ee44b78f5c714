"""Job states, their sets and transitions, and derived stage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States, their order and their sets.
ACTIVE = ("pending", "transcribing", "diarizing", "aligning", "indexing", "reindexing")
RESTARTABLE = ("failed", "cancelled")
DOWNLOADABLE = ("completed", "reindexing", "failed")
REINDEXABLE = ("completed", "failed")
STAGES = ("transcribing", "diarizing", "aligning", "indexing")
NEXT = {
    "pending": ("transcribing", "failed", "cancelled"),
    "transcribing": ("diarizing", "failed", "cancelled"),
    "diarizing": ("aligning", "failed", "cancelled"),
    "aligning": ("indexing", "failed", "cancelled"),
    "indexing": ("completed", "failed", "cancelled"),
    "completed": ("reindexing",),
    "reindexing": ("completed", "failed", "cancelled"),
    "failed": ("pending", "reindexing"),
    "cancelled": ("pending",),
}


def stage_states(current: Column, status: Column) -> Column:
    """Map stage -> completed, active, failed, cancelled or pending."""
    stages = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(stages, current)

    def state(k: int) -> Column:
        here = F.when(status.isin("failed", "cancelled"), status).otherwise("active")
        return F.when(status == "completed", "completed").when(at == 0, "pending").when(F.lit(k) < at, "completed").when(F.lit(k) == at, here).otherwise("pending")

    return F.create_map(*[x for k, s in enumerate(STAGES) for x in (F.lit(s), state(k + 1))])


def scaled_progress(stage: Column, pct: Column) -> Column:
    """Overall per cent of a stage's per cent."""
    return (
        F.when(stage == "transcribing", pct * 0.4).when(stage == "diarizing", 40 + pct * 0.25).when(stage == "indexing", 78 + pct * 0.17)
        .when(stage == "pageindex", 95 + pct * 0.04).when(stage == "reindexing", 20 + pct * 0.75).otherwise(pct)
    )


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows of (job_id, seq, status) that don't follow from the job's row before."""
    by = Window.partitionBy("job_id").orderBy("seq")
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    rows = log.withColumn("before", F.lag("status").over(by)).where("before IS NOT NULL AND before <> status")
    return rows.where(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False)))


def cancellable(status: Column) -> Column:
    return status.isin(*ACTIVE)


def restartable(status: Column) -> Column:
    return status.isin(*RESTARTABLE)


def downloadable(status: Column) -> Column:
    return status.isin(*DOWNLOADABLE)


def reindexable(status: Column) -> Column:
    return status.isin(*REINDEXABLE)


def searchable(status: Column, index_dir: Column) -> Column:
    """Completed, and with an index."""
    return (status == "completed") & (F.coalesce(index_dir, F.lit("")) != "")


def embed_progress(done: Column, total: Column) -> Column:
    """Per cent of embedding: 40 to 85 by rows done; by batches (`done`), up to 84, where the total isn't known."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, 40 + done / total * 45).otherwise(F.least(F.lit(84), 40 + 2 * done).cast("double"))


def shown_progress(stage_progress: Column, progress: Column) -> Column:
    """The stage's per cent, or the overall one where the stage has none."""
    return F.coalesce(F.nullif(stage_progress, F.lit(0.0)), progress)


def life_cycle(log: DataFrame) -> DataFrame:
    """(job_id, status, started_at, completed_at) of a log (job_id, seq, status, ts): the first transcribing, and the last end if the job is at one."""
    last = F.max_by(F.struct("status", "ts"), "seq")
    out = log.groupBy("job_id").agg(last.alias("l"), F.min_by("ts", F.when(F.col("status") == "transcribing", F.col("seq"))).alias("started_at"))
    return out.select("job_id", "l.status", "started_at", F.when(F.col("l.status").isin("completed", "failed"), F.col("l.ts")).alias("completed_at"))
