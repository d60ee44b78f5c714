"""From raw documents to token ids in five stages; each reads what the one before it wrote.

Every stage works on empty tables (no rows come out), keeps all columns of its input but for the last, judges each row of a
repeated id by its own text, and counts a null text as empty. Where copies are dropped, a row without an id stays only if no
row with an id has its text (exact copies) or at all (near copies).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import encode
from parlance.llm.exact_dedup import drop_copies
from parlance.llm.mixing import mix_copies
from parlance.llm.near_copies import drop_near_copies
from parlance.llm.shared import shared_dir
from parlance.llm.toxicity import drop_toxic

#: Near copies and source weights can't be stated in SQL without the hash functions, so run() is tested by its stages.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; empty texts aren't, nor is any without a single label."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z), the document with the largest id; of rows that repeat it and its text one stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest id.

    SimHash's fingerprints, blocks and distance find the closest, verified by their shingles; pairs at 0.8 differ in about ten of 64
    bits, so MinHash bands then complete the groups (see the README)."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, empty ones never."""
    return mix_copies(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    import public_tokenizers

    ids = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, round_trip=True, carry=["doc_id", "source"])
    return ids.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
