"""Joining transcripts of overlapping audio windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import strip
from parlance.operators.lineage import stored
from parlance.operators.scan import running, same_named


def windows(recordings: DataFrame, length: float, overlap: float) -> DataFrame:
    """(job_id, n, start, end) of windows over `duration`; the last may lie inside the one before."""
    step = max(0.1, length - overlap)
    n = F.ceil(F.col("duration") / step - 1e-9).cast("int")
    rows = recordings.where("duration > 0").select("job_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    start = F.round(F.col("n") * step, 6)
    return rows.select("job_id", "n", start.alias("start"), F.round(F.least(start + length, F.col("duration")), 6).alias("end")).where("start < end")


def absolute_time(value: Column, base: Column) -> Column:
    """A time that looks relative to its window, moved to the recording's time."""
    relative = (value < base - 0.1) | ((value < 10000) & (value < base))
    return F.when((base != 0) & relative, value + base).otherwise(value)


def safe_chunk_seconds(nominal: Column, bytes_per_second: Column, max_bytes: int) -> Column:
    """Seconds of a window that stays below a size: at least one, at most `nominal`, which holds where the rate isn't known."""
    rate = bytes_per_second * 0.8
    return F.when(rate > 0, F.greatest(F.lit(1.0), F.least(nominal, F.greatest(F.lit(1.0), F.floor(max_bytes / rate).cast("double"))))).otherwise(nominal)


PART = "array<struct<start:double,end:double,text:string,transcript:string,timestamp:array<double>,time:array<double>>>"


def window_segments(results: DataFrame) -> DataFrame:
    """(job_id, n, ord, start, end, text) in the recording's time, of windows (job_id, n, start, segments, raw).

    `segments` and `raw` are JSON. Without segments, raw counts: its segments, its chunks (with timestamp pairs), its text as one
    segment, or raw itself if it is a list."""
    raw = F.col("raw")
    within = lambda name: F.get_json_object(raw, f"$.{name}")
    is_list = F.startswith(F.trim(raw), F.lit("["))
    text = F.to_json(F.array(F.struct(F.lit(0.0).alias("start"), within("text").alias("text"))))
    listed = F.coalesce(F.when(F.col("segments") != "[]", F.col("segments")), within("segments"), within("chunks"), F.when(within("text").isNotNull(), text), F.when(is_list, raw))
    rows = results.select("job_id", "n", F.coalesce("start", F.lit(0.0)).alias("base"), F.posexplode(F.from_json(listed, PART)).alias("ord", "s"))
    time = lambda name, k: absolute_time(F.coalesce(F.col(f"s.{name}"), F.get("s.timestamp", F.lit(k)), F.get("s.time", F.lit(k))), F.col("base"))
    return rows.select("job_id", "n", F.col("ord").cast("bigint").alias("ord"), time("start", 0).alias("start"), time("end", 1).alias("end"), F.coalesce(F.nullif("s.text", F.lit("")), "s.transcript", F.lit("")).alias("text"))


def snap(edges: DataFrame, tolerance: float) -> DataFrame:
    """Window edges moved to silence: `points` is a sorted array; a start takes the first point, an end the last, within reach."""
    start, end = F.col("start"), F.col("end")
    near = lambda x: F.filter("points", lambda p: (F.abs(p - x) <= tolerance))
    first = F.array_min(F.filter(near(start), lambda p: p <= end))
    last = F.array_max(F.filter(near(end), lambda p: p >= start))
    return edges.withColumn("start", F.coalesce(first, start)).withColumn("end", F.coalesce(last, end))


def silence_pairs(lines: DataFrame, min_len: float) -> DataFrame:
    """(job_id, start, end) from ordered rows (job_id, ord, kind, at): each end with the start before it."""
    from pyspark.sql import Window

    by = Window.partitionBy("job_id").orderBy("ord")
    rows = lines.withColumn("kind_before", F.lag("kind").over(by)).withColumn("at_before", F.lag("at").over(by)).where("kind = 'end'")
    start = F.when(F.col("kind_before") == "start", F.col("at_before")).otherwise(F.greatest(F.lit(0.0), F.col("at") - min_len))
    return rows.select("job_id", start.alias("start"), F.col("at").alias("end"))


#: Where segments without a start stand among the others.
LAST = 1e12


def stitch(segments: DataFrame, tolerance: float = 0.25, width: float = 600.0) -> DataFrame:
    """One recording's segments (job_id, ord, start, end, text) without overlap, by start (null last), then ord.

    A start more than `tolerance` before the end of the segment that stays before it moves to that end; a segment that would be empty is
    left out and gives its text to the one before. A segment stays whatever its times if it is the first, has no start, or
    follows one without an end; from there on, the end that counts is the greatest one since. (A segment shorter than the tolerance may
    stay although it ends earlier, but then no later start is so early that the difference shows.) So this is a running
    maximum, taken in buckets of `width` seconds, and not a loop over a job. Segments without times and text aren't there."""
    rows = segments.selectExpr("job_id", "ord", "cast(start as double) start", "cast(end as double) end", "text")
    rows = stored(rows.where("start IS NOT NULL OR end IS NOT NULL OR coalesce(text, '') <> ''"))
    key, order = F.coalesce("start", F.lit(LAST)), [F.coalesce("start", F.lit(LAST)), F.col("ord")]
    scan = lambda df, **found: stored(running(df, ["job_id"], F.floor(key / width), order, **found))
    slim = scan(rows.drop("text"), tops={"before": F.struct(key.alias("key"), F.col("ord").alias("ord"), "end")})
    slim = slim.withColumn("first", F.col("before").isNull() | F.col("start").isNull() | F.col("before.end").isNull()).drop("before")
    slim = scan(slim, sums={"part": F.col("first").cast("int")}).withColumn("part", F.col("part") + F.col("first").cast("int"))
    counts = F.col("end").isNotNull() & (F.col("first") | (F.col("start") < F.col("end")))
    slim = scan(slim, tops={"most": F.when(counts, F.struct("part", "end"))})
    most = F.when(~F.col("first"), F.col("most.end"))
    moved = F.coalesce(F.col("start") < most - tolerance, F.lit(False))
    start = F.when(moved, most).otherwise(F.col("start"))
    stays = F.col("first") | F.col("end").isNull() | (start < F.col("end"))
    slim = scan(slim.select("job_id", "ord", "start", "end", start.alias("new"), stays.alias("stays")), sums={"place": F.col("stays").cast("int")})
    slim = slim.withColumn("place", F.col("place") + F.col("stays").cast("int"))
    a, b = slim.alias("a"), rows.alias("b")
    met = a.join(b, same_named("a", "b", ["job_id"]) & F.col("a.ord").eqNullSafe(F.col("b.ord")) & F.col("a.start").eqNullSafe(F.col("b.start")) & F.col("a.end").eqNullSafe(F.col("b.end")))
    met = met.select("a.*", strip(F.coalesce("b.text", F.lit(""))).alias("text"))
    lines = F.array_sort(F.collect_list(F.struct(key.alias("key"), "ord", "text")))
    out = met.groupBy("job_id", "place").agg(F.max(F.when(F.col("stays"), F.struct("ord", "new", "end"))).alias("kept"), lines.alias("lines"))
    text = F.array_join(F.filter(F.transform("lines", lambda x: x.text), lambda x: x != ""), " ")
    return out.select("job_id", "kept.ord", F.col("kept.new").alias("start"), "kept.end", text.alias("text"))
