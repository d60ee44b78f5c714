"""The library's life cycles as plans: align, index, reindex, and answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.intent import detect_intent
from parlance.operators import align, chunk, index, retrieve


def align_jobs(asr: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments (job_id, idx, start, end, speaker, text) of recordings."""
    return align.merge_runs(align.assign_speakers(asr, intervals)).withColumnRenamed("run", "idx")


def build_index(segments: DataFrame, embed, chunk_tokens: int = 300, overlap: int = 50) -> DataFrame:
    """Index rows of all levels with embeddings; `embed` maps a text column to a vector column."""
    normal = chunk.normalise(segments.select("job_id", "idx", "text", "speaker", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end")))
    docs = index.index_docs(segments, chunk.chunk(normal, chunk_tokens, overlap))
    return docs.withColumn("embedding", embed(F.col("text")))


def answer_candidates(docs: DataFrame, questions: DataFrame, embed, k: int = 4) -> DataFrame:
    """Diverse candidates for questions (query_id, question): level by intent, recall and context by the level's limits, then MMR; (query_id, rank, id)."""
    asked = questions.withColumn("level", detect_intent(F.col("question"))).withColumn("q", embed(F.col("question")))
    segments = docs.agg(F.count_if(F.col("level") == "segment").alias("segment_count"))
    asked = retrieve.level_limits(asked.join(F.broadcast(segments)).withColumn("k", F.lit(None).cast("int")), k)
    recalled = None
    for level in ("document", "segment", "chunk"):
        mine = asked.where(F.col("level") == level)
        most = mine.agg(F.max("recall_n")).first()[0] or 0
        if most:
            some = retrieve.knn(retrieve.with_level_fallback(docs, level), mine.select("query_id", "q"), most, id_col="id")
            recalled = some if recalled is None else recalled.unionByName(some)
    limits = asked.select("query_id", "q", "recall_n", "context_n")
    rows = recalled.join(docs.select("id", "embedding"), "id").join(limits, "query_id").where(F.col("rank") <= F.col("recall_n")).withColumn("pos", F.col("rank") - 1)
    order = retrieve.mmr(rows, limits.agg(F.max("context_n")).first()[0])  # a shorter selection is the beginning of a longer one
    return order.join(rows.select("query_id", "pos", "id", "context_n"), ["query_id", "pos"]).where(F.col("rank") <= F.col("context_n")).select("query_id", "rank", "id")
