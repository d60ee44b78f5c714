"""Files of JSON documents, good rows and broken ones from one scan, as a batch or as a stream.

A file that begins with a bracket or a brace is one JSON text: a list of documents, an object with a list in `segments`, or one document.
Other files, and all files with `lines`, hold a JSON object a line. What can't be read is a row with a reason instead of an error:
(file, line, doc, reason); a line number counts from 1 and is null where the whole file is at fault. Blank files and lines have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "array<struct<line:bigint,doc:string,reason:string>>"


def row(line: Column, doc: Column, reason: Column) -> Column:
    return F.struct(line.cast("bigint").alias("line"), doc.alias("doc"), reason.cast("string").alias("reason"))


def parsed(raw: DataFrame, lines: bool = False) -> DataFrame:
    """(file, line, doc, reason) of whole files (file, value); works on streams."""
    none = F.lit(None)
    body = F.regexp_replace("value", r"^[\s﻿]+|\s+$", "")
    files = raw.select("file", body.alias("value"), F.col("value").alias("all")).where("value <> ''").withColumn("v", F.try_parse_json("value"))
    listed, segments = F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.segments", "array<variant>")
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    each = lambda xs: F.transform(xs, lambda x: row(none, F.to_json(x), none))
    whole = (
        F.when(F.col("v").isNull(), F.array(row(none, none, F.lit("not JSON"))))
        .when(F.startswith("value", F.lit("[")), each(listed))
        .when(F.map_contains_key(fields, "segments"), F.coalesce(each(segments), F.array(row(none, none, F.lit("segments is not a list")))))
        .otherwise(F.array(row(none, F.to_json("v"), none)))
    )

    def one(text: Column, place: Column) -> Column:
        v = F.try_parse_json(text)
        reason = F.when(v.isNull(), "not JSON").when(~F.startswith(F.trim(text), F.lit("{")), "not an object")
        return row(place + 1, F.when(reason.isNull(), F.to_json(v)), reason)

    by_line = F.filter(F.transform(F.split("all", "\n"), lambda x, i: F.when(F.regexp_like(x, F.lit(r"[^\s﻿]")), one(F.regexp_replace(x, r"^[\s﻿]+|\s+$", ""), i))), lambda x: x.isNotNull())
    rows = by_line if lines else F.when(F.startswith("value", F.lit("[")) | F.startswith("value", F.lit("{")), whole.cast(ROW)).otherwise(by_line.cast(ROW))
    return files.select("file", F.explode(rows.cast(ROW)).alias("r")).select("file", "r.*")


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), lines)


def stream_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The same over files as they arrive in a folder."""
    return parsed(spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), lines)


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (file, line, doc), and the quarantine (file, line, reason)."""
    return rows.where("reason IS NULL").select("file", "line", "doc"), rows.where("reason IS NOT NULL").select("file", "line", "reason")
