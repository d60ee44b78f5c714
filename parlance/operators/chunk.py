"""Segments: normal form, speaker-aware chunks with overlap, turns, blocks and size-bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import first_filled, strip, token_estimate
from parlance.operators.lineage import stored
from parlance.operators.scan import lookahead, orbit, running, same_named

#: Rows of one bucket of indices when numbers and sums run over a job.
WIDTH = 4096


def normalise(raw: DataFrame) -> DataFrame:
    """(job_id, pos, idx, text, speaker, start, end) from rows with any of the known field names; blank texts are dropped."""
    have = set(raw.columns)
    pick = lambda *names: [F.col(n) for n in names if n in have]
    text = strip(first_filled(*pick("text", "transcript", "chunk_text"), F.lit(None).cast("string")))
    speaker = first_filled(*pick("speaker", "spk", "speaker_label"), F.lit("unknown"))
    arrays = pick("timestamp", "timestamps")

    def time(name: str, place: int, default: Column) -> Column:
        scalar = F.col(name) if name in have else F.lit(None).cast("string")
        pair = F.coalesce(*[F.get(a, place) for a in arrays], F.lit(None).cast("double")) if arrays else F.lit(None).cast("double")
        return F.when(scalar.isNotNull(), F.coalesce(scalar.try_cast("double"), default)).otherwise(F.coalesce(pair.cast("double"), default))

    rows = raw.withColumn("n_text", text).withColumn("n_speaker", speaker).withColumn("n_start", time("start", 0, F.lit(0.0)))
    rows = rows.withColumn("n_end", time("end", 1, F.col("n_start"))).where(F.coalesce(F.col("n_text"), F.lit("")) != "")
    rows = running(rows, ["job_id"], F.floor(F.col("idx") / WIDTH), ["idx"], {"n_pos": F.lit(1)})
    return rows.select("job_id", F.col("n_pos").cast("int").alias("pos"), "idx", F.col("n_text").alias("text"), F.col("n_speaker").alias("speaker"), F.col("n_start").alias("start"), F.col("n_end").alias("end"))


def chunk_steps(rows: DataFrame, limit: int, carry: int) -> DataFrame:
    """(job_id, pos, back, next): a chunk whose first new row is `pos` begins with the rows from `back` on, and the next one's first new row is `next`.

    `rows` (job_id, pos, at, size, speaker, before): sizes add up to `at` before a row, `before` is the row before. What is carried over
    is the longest tail within `carry` (one row at least), so it depends on `pos` alone, and so does where the chunk is full or, half
    full, the speaker changes. All of it lies within limit + carry of the row, so blocks of sizes see it without the rest of the job."""
    half, reach = limit // 2, limit + carry
    changed = F.col("before.pos").isNull() | ~F.col("before.speaker").eqNullSafe(F.col("speaker"))
    near = lookahead(rows.withColumn("change", F.when(changed, F.col("pos"))), reach, 16 * reach, reach)
    by = Window.partitionBy("job_id", "block").orderBy("at")
    near = near.withColumn("back", F.greatest(F.lit(0), F.least(F.min("pos").over(by.rangeBetween(-carry, 0)), F.col("pos") - 1)))
    near = near.withColumn("full", F.max(F.struct("pos", (F.col("at") + F.col("size")).alias("end"))).over(by.rangeBetween(0, limit)))
    near = near.withColumn("half", F.max("pos").over(by.rangeBetween(0, half - 1)) + 1 if half else F.col("pos"))
    later = Window.partitionBy("job_id", "block").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("turn", F.min("change").over(later))
    one = F.struct("pos", "at", "size", "speaker", "back", "full", "half", "turn", "core", F.col("before.size").alias("size_before"))
    blocks = near.groupBy("job_id", "block").agg(F.array_sort(F.collect_list(one)).alias("rows"))

    def step(r: Column) -> Column:
        place = lambda pos: F.get("rows", (pos - F.col("rows")[0].pos).cast("int"))
        first, soon = place(r.back), r.pos + 1
        full = F.greatest(soon, F.when(first.full.end > first.at + limit, first.full.pos).otherwise(first.full.pos + 1))
        turn = place(F.greatest(soon, first.half))
        turn = F.when(~turn.speaker.eqNullSafe(r.speaker), turn.pos).otherwise(turn.turn)
        over = (r.back == r.pos - 1) & (r.size_before > limit)
        return F.struct(r.pos.alias("pos"), r.back.alias("back"), F.when(over, soon).otherwise(F.least(full, turn)).alias("next"))

    steps = F.transform(F.filter("rows", lambda r: r.core), step)
    return blocks.select("job_id", F.explode(steps).alias("s")).select("job_id", "s.*")


def chunk(normal: DataFrame, chunk_tokens: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping chunks per job. Where a chunk ends follows from where its new rows begin, so the chunks of a job are a path of
    successors from its first row (`orbit`); no task sees a whole job."""
    limit, carry = max(1, chunk_tokens), max(0, min(overlap, chunk_tokens // 2))
    rows = stored(normal.withColumn("job_id", F.col("job_id").cast("string")))
    sized = rows.select("job_id", F.col("pos").cast("bigint").alias("pos"), token_estimate(F.col("text")).alias("size"), "speaker")
    place = F.floor(F.col("pos") / WIDTH)
    sized = running(sized, ["job_id"], place, ["pos"], {"at": F.col("size")}, {"before": F.struct("pos", "size", "speaker")})
    steps = stored(chunk_steps(sized, limit, carry))
    begins = orbit(steps, ["job_id"])
    begins = steps.alias("s").join(begins.alias("b"), same_named("s", "b", ["job_id"]) & (F.col("s.pos") == F.col("b.pos"))).select("s.*")
    begins = running(begins, ["job_id"], place, ["pos"], {"chunk_id": F.lit(1)})
    held = begins.select("job_id", "chunk_id", F.col("pos").alias("fresh"), F.explode(F.sequence("back", F.col("next") - 1)).alias("at"))
    said = F.when((F.col("at") >= F.col("fresh")) & (F.coalesce("r.speaker", F.lit("")) != "") & (F.lower("r.speaker") != "unknown"), F.concat("r.speaker", F.lit(": "), "r.text")).otherwise(F.col("r.text"))
    met = held.alias("h").join(rows.alias("r"), same_named("h", "r", ["job_id"]) & (F.col("h.at") == F.col("r.pos"))).select("h.job_id", "h.chunk_id", "at", "r.idx", "r.speaker", "r.start", "r.end", said.alias("text"))
    line = F.array_sort(F.collect_list(F.struct("at", "idx", "text")))
    who = [F.min(F.struct("speaker")).alias("least"), F.max(F.struct("speaker")).alias("most")]
    out = met.groupBy("job_id", "chunk_id").agg(line.alias("l"), *who, F.min_by("start", "at").alias("start"), F.max_by("end", "at").alias("end"))
    return out.select(
        "job_id", F.col("chunk_id").cast("int").alias("chunk_id"), F.array_join(F.transform("l", lambda x: x.text), " ").alias("text"),
        F.when(F.col("least").eqNullSafe(F.col("most")), F.col("most.speaker")).otherwise("multiple").alias("speaker"), "start", "end",
        F.transform("l", lambda x: x["at"].cast("int")).alias("positions"), F.transform("l", lambda x: x.idx.cast("int")).alias("segment_ids"),
    )


def turns(segments: DataFrame) -> DataFrame:
    """Runs of one speaker: (job_id, turn, speaker, first_idx, last_idx, title)."""
    by = Window.partitionBy("job_id").orderBy("idx")
    rows = segments.withColumn("new", F.when(F.lag("speaker").over(by) == F.col("speaker"), 0).otherwise(1)).withColumn("turn", F.sum("new").over(by) - 1)
    out = rows.groupBy("job_id", "turn").agg(F.first("speaker").alias("speaker"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return out.withColumn("title", F.concat("speaker", F.lit(": discussion")))


def blocks(segments: DataFrame, size: int = 15) -> DataFrame:
    """Fixed blocks: (job_id, topic, title, start_segment, end_segment)."""
    out = segments.groupBy("job_id", F.floor(F.col("idx") / size).cast("bigint").alias("topic")).agg(F.min("idx").alias("start_segment"), F.max("idx").alias("end_segment"))
    return out.withColumn("title", F.concat(F.lit("Topic "), (F.col("topic") + 1).cast("string")))


def group_by_size(segments: DataFrame, most: int = 3000) -> DataFrame:
    """(job_id, idx, group): consecutive rows while their characters stay within `most`; a group is never empty.

    Among rows with text, a group's successor begins with the first row that no longer fits, which follows from the group's first
    row; the groups are the path from the first. A row without text belongs to the group before it, unless that is one row over `most`."""
    rows = stored(segments.select("job_id", "idx", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size")))
    bucket = F.floor(F.col("idx") / WIDTH)
    some = running(rows.where("size > 0"), ["job_id"], bucket, ["idx"], {"pos": F.lit(1), "at": F.col("size")})
    some = stored(some)
    near = lookahead(some, most, 8 * most)
    by = Window.partitionBy("job_id", "block").orderBy("at")
    near = near.withColumn("last", F.max(F.struct("pos", (F.col("at") + F.col("size")).alias("end"))).over(by.rangeBetween(0, most)))
    fits = F.when(F.col("last.end") > F.col("at") + most, F.col("last.pos")).otherwise(F.col("last.pos") + 1)
    steps = near.where("core").select("job_id", "pos", F.greatest(F.col("pos") + 1, fits).alias("next"))
    begins = orbit(steps, ["job_id"]).withColumn("begins", F.lit(1))
    met = some.alias("s").join(begins.alias("b"), same_named("s", "b", ["job_id"]) & (F.col("s.pos") == F.col("b.pos"))).select("s.job_id", "s.idx", "begins")
    marked = rows.alias("r").join(met.alias("m"), same_named("r", "m", ["job_id"]) & (F.col("r.idx") == F.col("m.idx")), "left").select("r.job_id", "r.idx", "r.size", F.coalesce("m.begins", F.lit(0)).alias("begins"))
    out = running(marked, ["job_id"], bucket, ["idx"], {"sum": F.col("begins")}, {"last": F.when(F.col("size") > 0, F.struct("idx", "size"))})
    after = F.when(F.col("size") == 0, F.when(F.col("last.size") > most, 1).otherwise(0)).otherwise(F.col("begins"))
    return out.select("job_id", "idx", F.greatest(F.lit(0), F.col("sum") + after - 1).cast("bigint").alias("group"))


def with_tokens(segments: DataFrame) -> DataFrame:
    return segments.withColumn("tokens", token_estimate(F.col("text")))
