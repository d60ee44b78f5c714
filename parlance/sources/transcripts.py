"""Transcripts in and out: JSON in its two shapes, JSON lines, ASR results, and prepared documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.status import downloadable
from parlance.functions.text import SPACE, strip

SEGMENT = "struct<start:string,end:string,text:string,transcript:string,chunk_text:string,speaker:string,spk:string,speaker_label:string,timestamp:array<double>,timestamps:array<double>>"
#: Fixed value: how a text names its speaker.
PREFIX = rf"(?d)^{SPACE}*([A-Za-z0-9_\-{SPACE}]{{1,40}}):{SPACE}*(.*)$"


def must_parse(value: Column, file: Column) -> Column:
    """The text, or an error that names the file if it isn't JSON."""
    return F.when(F.try_parse_json(value).isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), file)).cast("string"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, idx, fields…) of files that hold an array of segments or an object with `segments`; job_id is the file's stem.

    A file that doesn't parse is an error, an empty one has no segments."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value")).where("value <> ''")
    raw = raw.withColumn("value", must_parse(F.col("value"), F.col("file")))
    listed = F.from_json("value", f"array<{SEGMENT}>")
    held = F.from_json("value", f"struct<segments:array<{SEGMENT}>>")["segments"]
    segments = F.when(F.startswith("value", F.lit("[")), listed).otherwise(held)
    rows = raw.select(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("job_id"), F.posexplode(segments).alias("idx", "s"))
    return rows.select("job_id", "idx", "s.*")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, doc) of files that begin with a bracket (one JSON array or object each) or else hold a document a line.

    `doc` is the JSON text of each element. Empty files have none; what doesn't parse is an error, as are lines of objects in a file that begins with one."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value")).where("value <> ''")
    whole = F.startswith("value", F.lit("[")) | F.startswith("value", F.lit("{"))
    one = raw.where(whole).withColumn("value", must_parse(F.col("value"), F.col("file")))
    parts = F.when(F.startswith("value", F.lit("[")), F.variant_get(F.parse_json("value"), "$", "array<variant>")).otherwise(F.array(F.parse_json("value")))
    one = one.select("file", F.posexplode(parts).alias("idx", "v")).select("file", "idx", F.to_json("v").alias("doc"))
    lines = raw.where(~whole).select("file", F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("idx", "doc"))
    return one.unionByName(lines.withColumn("doc", must_parse(F.col("doc"), F.col("file"))))


def read_trees(spark: SparkSession, trees: str, contents: str) -> DataFrame:
    """(job_id, tree, contents) of tree files and the content maps beside them (by stem); a missing map is an empty one."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*?)(_content_map)?(\.[^./]*)?$", 1)
    read = lambda path, name: spark.read.text(path, wholetext=True).select(stem.alias("job_id"), F.col("value").alias(name))
    return read(trees, "tree").join(read(contents, "contents"), "job_id", "left").withColumn("contents", F.coalesce("contents", F.lit("{}")))


def write_cache(results: DataFrame, path: str) -> None:
    """Results (key, value) by key; a value that isn't JSON is kept as raw text."""
    kept = F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.to_json(F.struct(F.col("value").alias("raw_text"))))
    results.select("key", kept.alias("value")).write.mode("append").parquet(path)


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """`wanted` (key, ...) with the cached value, null where there is none or it is broken: such a row is a miss and made again."""
    good = cache.where(F.try_parse_json("value").isNotNull()).groupBy("key").agg(F.max("value").alias("value"))
    return wanted.join(good, "key", "left")


def stage_outputs(jobs: DataFrame) -> DataFrame:
    """(job_id, name, json) of what a job's stages left (job_id, status, transcription, diarization, aligned), as far as it may be downloaded."""
    files = F.create_map(*[x for n in ("transcription", "diarization", "aligned") for x in (F.lit(n), F.col(n))])
    return jobs.where(downloadable(F.col("status"))).select("job_id", F.explode(files).alias("name", "json")).where("json IS NOT NULL")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line that isn't blank; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def asr_segments(results: DataFrame) -> DataFrame:
    """(job_id, ord, start, end, text) from results with `chunks` (timestamp pairs) or `segments`; rows without both times go."""
    from_chunks = F.transform("chunks", lambda c: F.struct(F.get(c["timestamp"], 0).alias("start"), F.get(c["timestamp"], 1).alias("end"), c["text"].alias("text")))
    plain = F.transform("segments", lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), s["text"].alias("text")))
    rows = results.select("job_id", F.posexplode(F.coalesce(from_chunks, plain)).alias("ord", "s")).select("job_id", F.col("ord").cast("bigint").alias("ord"), "s.*")
    return rows.where("start IS NOT NULL AND end IS NOT NULL")


def speaker_prefix(rows: DataFrame) -> DataFrame:
    """A speaker that the text names in front (`name: text`, in one line), where none is given; texts and names lose white space at their ends.

    Only \\n ends a line. A name of nothing but white space is none."""
    text = strip(F.coalesce("text", F.lit("")))
    found = rows.withColumn("text", text).withColumn("__name", strip(F.regexp_extract("text", PREFIX, 1)))
    hit = F.col("speaker").isNull() & (F.col("__name") != "")
    named = found.withColumn("text", F.when(hit, strip(F.regexp_extract("text", PREFIX, 2))).otherwise(F.col("text")))
    return named.withColumn("speaker", F.when(hit, F.col("__name")).otherwise(F.col("speaker"))).drop("__name")


def write_prepared(segments: DataFrame, path: str) -> None:
    """JSON lines of segments, each text with its speaker in front."""
    segments.withColumn("text", F.concat_ws(": ", "speaker", "text")).write.mode("overwrite").json(path)


def nested(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, json): the aligned result {input_file, duration_seconds, segments, n_segments} of each job (job_id, filename)."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "speaker", "text"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["speaker"].alias("speaker"), s["text"].alias("text")))
    out = segments.groupBy("job_id").agg(items.alias("segments"), F.max_by("end", "idx").alias("duration_seconds"), F.count(F.lit(1)).alias("n_segments")).join(jobs, "job_id")
    return out.select("job_id", F.to_json(F.struct(F.regexp_extract("filename", "[^/]*$", 0).alias("input_file"), "duration_seconds", "segments", "n_segments")).alias("json"))


def patch_json(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """`documents` (job_id, json, …) with the speaker and text of the segments that `edits` (job_id, idx, speaker, text) names by their place set in the JSON.

    A document is a list of segments or an object that holds one in `segments`. Both shapes, all other fields of segments and of the
    object stay; only the order of an object's fields may change. A null is set as null; an edit of a place that isn't there changes
    nothing; of several edits of a place one counts. A document of another shape is an error."""
    by_place = edits.groupBy("job_id", "idx").agg(F.max(F.struct("speaker", "text")).alias("e")).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("bigint").alias("k"), "e"))).alias("__edits"))
    rows = documents.join(by_place, "job_id", "left").withColumn("__doc", F.parse_json("json"))
    kind = F.schema_of_variant("__doc")
    fields, is_list = F.try_variant_get("__doc", "$", "map<string,variant>"), F.startswith(kind, F.lit("ARRAY"))
    listed = F.coalesce(F.try_variant_get("__doc", "$.segments", "array<variant>"), F.when(is_list, F.try_variant_get("__doc", "$", "array<variant>")))
    wrong = F.raise_error(F.concat(F.lit("neither a list of segments nor an object with one: job "), F.col("job_id").cast("string"))).cast("string")
    said = lambda x: F.coalesce(x.cast("variant"), F.parse_json(F.lit("null")))

    def patched(segment: Column, place: Column) -> Column:
        edit, others = F.col("__edits")[place.cast("bigint")], F.map_filter(F.variant_get(segment, "$", "map<string,variant>"), lambda k, _: ~k.isin("speaker", "text"))
        new = F.map_concat(others, F.create_map(F.lit("speaker"), said(edit.speaker), F.lit("text"), said(edit.text)))
        return F.when(edit.isNull(), segment).otherwise(F.to_variant_object(new))

    segments = F.transform(listed, patched)
    whole = F.map_concat(F.map_filter(fields, lambda k, _: k != "segments"), F.create_map(F.lit("segments"), segments.cast("variant")))
    new = F.when(is_list, F.to_json(segments)).otherwise(F.to_json(F.to_variant_object(whole)))
    return rows.withColumn("json", F.when(F.col("__edits").isNull(), F.col("json")).when(listed.isNull(), wrong).otherwise(new)).select(*documents.columns)


def settings_overlay(defaults: DataFrame, stored: DataFrame, hidden: tuple[str, ...] = (), masked: tuple[str, ...] = ()) -> DataFrame:
    """(key, value): the stored value else the default; hidden keys are empty, masked ones dots."""
    out = defaults.select("key", F.col("value").alias("d")).join(stored.select("key", F.col("value").alias("s")), "key", "left")
    return out.select("key", F.when(F.col("key").isin(*hidden), F.lit("")).when(F.col("key").isin(*masked), F.lit("••••••••")).otherwise(F.coalesce("s", "d")).alias("value"))
