"""Index documents at three levels, content hashes, change detection and atomic snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import segment_hash, strip


def ordered_join(text: Column, order: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), sep)


def document_docs(segments: DataFrame) -> DataFrame:
    """One row a job: blanks keep their separators, the whole is stripped."""
    text = strip(ordered_join(strip(F.col("text")), F.col("idx"), " "))
    out = segments.groupBy("job_id").agg(text.alias("text"), F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"))
    return out.withColumn("level", F.lit("document")).withColumn("speaker", F.lit("multiple")).withColumn("id", F.concat(F.col("job_id").cast("string"), F.lit("_doc")))


def segment_docs(segments: DataFrame) -> DataFrame:
    """One row a segment with text; ids keep the original index."""
    rows = segments.where(strip(F.coalesce("text", F.lit(""))) != "")
    return rows.select("job_id", strip(F.col("text")).alias("text"), "start", "end", F.lit("segment").alias("level"), "speaker", F.concat_ws("_seg_", F.col("job_id").cast("string"), F.col("idx").cast("string")).alias("id"))


def chunk_docs(chunks: DataFrame) -> DataFrame:
    return chunks.select("job_id", "text", "start", "end", F.lit("chunk").alias("level"), "speaker", F.concat_ws("_", "job_id", F.col("chunk_id").cast("string")).alias("id"))


def index_docs(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """All three levels."""
    as_text = lambda df: df.withColumn("job_id", F.col("job_id").cast("string"))
    return as_text(document_docs(segments)).unionByName(as_text(segment_docs(segments))).unionByName(as_text(chunk_docs(chunks)))


def content_hash(segments: DataFrame) -> DataFrame:
    """(job_id, hash): SHA-256 over the ordered texts and speakers, without separators."""
    both = F.concat(F.coalesce("text", F.lit("")), F.coalesce("speaker", F.lit("")))
    return segments.groupBy("job_id").agg(F.sha2(ordered_join(both, F.col("idx"), ""), 256).alias("hash"))


def stale_jobs(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Jobs whose hash differs from a manifest (job_id, hash), or that it doesn't have."""
    known = manifest.select("job_id", F.col("hash").alias("known"))
    return content_hash(segments).join(known, "job_id", "left").where(F.coalesce(F.nullif("known", F.lit("")), F.lit("-")) != F.col("hash")).select("job_id", "hash")


def carry_over(docs: DataFrame, live: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, speaker) with the embedding of a live row of the same id and hash; null where one has to be made."""
    old = live.select("doc_id", F.col("content_hash").alias("old_hash"), "embedding")
    new = docs.withColumn("content_hash", segment_hash(F.col("text"), F.col("speaker")))
    return new.join(old, "doc_id", "left").withColumn("embedding", F.when(F.col("old_hash") == F.col("content_hash"), F.col("embedding"))).drop("old_hash")


def publish(df: DataFrame, root: str, **facts) -> str:
    """Write a new version and move the pointer to it in one step; readers see the old version until then. Returns its name."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, draft = (jvm.org.apache.hadoop.fs.Path(f"{root}/{name}") for name in ("CURRENT.json", f"CURRENT.{version}"))
    out = place.getFileSystem(conf).create(draft, True)
    out.write(json.dumps({"version": version} | facts).encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, place, over)
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The published version."""
    fact = json.loads(spark.read.text(f"{root}/CURRENT.json").first()[0])
    return spark.read.parquet(f"{root}/{fact['version']}")


#: The order of the levels in an index's hash.
ORDER = ("document", "segment", "chunk")


def index_hash(docs: DataFrame, model: str) -> DataFrame:
    """(job_id, hash): SHA-256 over the texts of all levels, in their order, and the model's name, so that another model makes an index stale."""
    level = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("level"))
    text = ordered_join(F.col("text"), F.struct(level.alias("l"), F.col("pos").alias("p")), "")
    return docs.groupBy("job_id").agg(F.sha2(F.concat(text, F.lit(model)), 256).alias("hash"))


def level_counts(docs: DataFrame) -> DataFrame:
    """(job_id, chunks): rows of the chunk level, or all rows of a job without any."""
    n = F.count_if(F.col("level") == "chunk")
    return docs.groupBy("job_id").agg(F.when(n > 0, n).otherwise(F.count(F.lit(1))).alias("chunks"))
