"""Speakers for timed text: overlap, nearest midpoint, and runs of one speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_speakers(asr: DataFrame, intervals: DataFrame, bucket_s: float = 30.0) -> DataFrame:
    """`asr` (job_id, ord, start, end, ...) with the speaker of the interval that overlaps most; ties go to the earlier interval.

    Rows without overlap take the interval whose midpoint is nearest, or `Unknown` in a job without intervals. Both sides meet
    by job and time bucket, so a long recording is spread over many keys; a pair that meets in several buckets changes no
    maximum. The nearest midpoint comes from ordered windows, not from pairs.
    """
    asr = asr.where("start IS NOT NULL AND end IS NOT NULL")
    buckets = lambda s, e: F.explode(F.sequence(F.floor(s / bucket_s), F.floor(F.greatest(s, e) / bucket_s)))
    left = asr.select("job_id", "ord", F.col("start").alias("a_s"), F.col("end").alias("a_e"), buckets(F.col("start"), F.col("end")).alias("b"))
    right = intervals.select("job_id", F.col("ord").alias("d_ord"), F.col("start").alias("d_s"), F.col("end").alias("d_e"), "speaker", buckets(F.col("start"), F.col("end")).alias("b"))
    overlap = F.least("a_e", "d_e") - F.greatest("a_s", "d_s")
    met = left.join(right, ["job_id", "b"]).where(overlap > 0)
    best = met.groupBy("job_id", "ord").agg(F.max_by("speaker", F.struct(overlap.alias("o"), (-F.col("d_ord")).alias("n"))).alias("by_overlap"))

    mids = intervals.groupBy("job_id", ((F.col("start") + F.col("end")) / 2).alias("mid")).agg(F.min(F.struct("ord", "speaker")).alias("i"))
    asked = asr.select("job_id", "ord", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    line = asked.select("job_id", "mid", F.col("ord").alias("a_ord"), F.lit(None).cast(mids.schema["i"].dataType).alias("i")).unionByName(mids.select("job_id", "mid", F.lit(None).cast("bigint").alias("a_ord"), "i").withColumn("a_ord", F.col("a_ord").cast(asked.schema["ord"].dataType)))
    known = F.when(F.col("i").isNotNull(), F.struct("mid", "i"))
    by = Window.partitionBy("job_id").orderBy("mid")
    line = line.withColumn("below", F.last(known, ignorenulls=True).over(by)).withColumn("above", F.first(known, ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing)))
    choice = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.mid") - F.col("mid")).alias("d"), F.col(f"{c}.i.ord").alias("n"), F.col(f"{c}.i.speaker").alias("speaker")))
    near = line.where("a_ord IS NOT NULL").select("job_id", F.col("a_ord").alias("ord"), F.least(choice("below"), choice("above"))["speaker"].alias("by_nearest"))
    out = asr.join(best, ["job_id", "ord"], "left").join(near, ["job_id", "ord"], "left")
    return out.withColumn("speaker", F.coalesce("by_overlap", "by_nearest", F.lit("Unknown"))).drop("by_overlap", "by_nearest")


def merge_runs(aligned: DataFrame, max_gap: float = 0.5) -> DataFrame:
    """Consecutive rows of one speaker with gaps of at most `max_gap` as one row (job_id, run, start, end, speaker, text)."""
    by = Window.partitionBy("job_id").orderBy("ord")
    same = (F.lag("speaker").over(by) == F.col("speaker")) & (F.col("start") - F.lag("end").over(by) <= max_gap)
    rows = aligned.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(by) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    runs = rows.groupBy("job_id", "run").agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.first("speaker").alias("speaker"), texts.alias("texts"))
    filled = F.filter(F.transform("texts", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    joined = F.array_join(F.slice("texts", F.coalesce(F.get(filled, 0), F.lit(0)) + 1, F.size("texts")), " ")  # empty texts before the first filled one are left out
    return runs.select("job_id", "run", "start", "end", "speaker", F.when(F.size(filled) > 0, joined).otherwise("").alias("text"))


def durations(segments: DataFrame) -> DataFrame:
    """The last segment's end and the largest end of each job."""
    return segments.groupBy("job_id").agg(F.coalesce(F.max_by("end", "ord"), F.lit(0.0)).alias("last_end"), F.coalesce(F.max("end"), F.lit(0.0)).alias("max_end"))
