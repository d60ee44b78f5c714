"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

Each normalised text has a 64-bit key. An entry of the index stands for one text: key, digest, number of rows and largest id; it
is aggregated before anything is shuffled, so a text with a third of all rows is one entry a task.
The directory maps leading bits of the key to buckets. It doubles for as long as a bucket holds more than `bucket_capacity`
distinct keys: each round takes one more bit for the overfull buckets alone, the others keep their smaller local depth. Entries
are written to the shared folder as one file or more for each bucket. Owner tasks take runs of buckets and chain the entries of
one key; the chains that hold more than one row then get the rows' texts, which are compared byte by byte in the owner of
their bucket: different texts under one key are different links of the chain, and each link gives its keep_id and group_size.
Only texts that a bounded filter of chained keys lets pass are moved for that, one for each task and text.

Defined results: a null text counts as empty; empty texts are copies of each other; a null id is the largest of a group only if
all ids of it are null (then keep_id is null and kept is true, else a null id's kept is false); rows that repeat an id and a text
are all kept or all not, `drop_copies` leaves one of them; an empty table gives no rows; other columns of the input are not read
(they pass through `drop_copies`, but for those whose names begin with two underscores, which may clash with its own).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import HOT_KEYS, ascii_lower, bit_table, shared_dir, skewed_join, stored, with_hit

#: Buckets at most: beyond that their capacity grows. It bounds what the directory's broadcast sends (24 bytes a bucket, twice as many at most).
MAX_BUCKETS = 1 << 16


def prefix(key: str, depth: int) -> Column:
    """The key's leading `depth` bits."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, list[int]]:
    """Rows (depth, prefix) of the buckets over distinct keys (column key), and the local depths that occur."""
    total = keys.count()
    capacity = max(capacity, -(-total // MAX_BUCKETS))
    # Below this depth some bucket is overfull for certain, so the first doublings need no counting.
    depth = max(0, (-(-total // capacity) - 1).bit_length()) if total else 0
    left, found, depths = keys, None, []
    while True:
        seen = left.groupBy(prefix("key", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("key").bitwiseXOR(F.max("key")).alias("differ"))
        counts = stored(seen.withColumn("depth", F.lit(depth)))
        full = counts.where(F.col("n") > capacity)
        # Doublings in which every overfull bucket's keys still share the next bit would split nothing: go to the first that does.
        shared = full.agg(F.min(F.lit(64) - F.length(F.bin("differ")))).first()[0]
        last = depth == 64 or shared is None
        fits = (counts if last else counts.where(F.col("n") <= capacity)).select("depth", "prefix")
        found = fits if found is None else found.unionByName(fits)
        depths.append(depth)
        if last:
            return found, depths
        left = left.withColumn("prefix", prefix("key", depth)).join(F.broadcast(full.select("prefix")), "prefix", "left_semi").select("key")
        depth = max(depth, shared) + 1


def with_bucket(rows: DataFrame, buckets: DataFrame, depths: list[int]) -> DataFrame:
    """`rows` (key, ...) with bucket (a text that orders as the keys do) and local_depth."""
    place = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix("key", d).alias("prefix")) for d in depths]))
    out = rows.withColumn("__at", place).select(*rows.columns, "__at.depth", "__at.prefix").join(F.broadcast(buckets), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, F.lit("b")).otherwise(F.concat(F.lit("b"), F.substring(F.lpad(F.bin(F.expr("shiftleft(prefix, 64 - depth)")), 64, "0"), F.lit(1), F.col("depth"))))
    return out.withColumn("bucket", name).withColumnRenamed("depth", "local_depth").drop("prefix")


def links(docs: DataFrame, id_col: str, text_col: str, bucket_capacity: int, key_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Entries of all rows (id, key, sha), the index (bucket, local_depth, key, sha, n, keep_id), the links of more than one row (key, sha, keep_id, group_size), and the number of rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("key", key_of(F.col("norm")))
    entries = stored(rows.select("id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")))
    texts = stored(entries.groupBy("key", "sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    buckets, depths = directory(texts.select("key").distinct(), bucket_capacity)
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    with_bucket(texts, buckets, depths).repartitionByRange("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(folder)
    index = spark.read.schema(f"local_depth int, key bigint, sha binary, keep_id {entries.schema['id'].dataType.simpleString()}, n bigint, bucket string").parquet(folder)
    # Owners of runs of buckets: grouping by bucket and key needs no other exchange.
    chains = stored(index.repartitionByRange("bucket").groupBy("bucket", "key").agg(F.sum("n").alias("n")).where("n > 1"))
    passed = with_hit(rows, "key", bit_table(chains, "key", chains.count()), "__hit").where("__hit").drop("__hit")
    # One row a task and text, before the texts go to their owners; false hits of the filter are single rows there.
    some = passed.groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    owned = with_bucket(some, buckets, depths).repartitionByRange("bucket")
    equal = owned.groupBy("bucket", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    return entries, index, stored(equal.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")), entries.count()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 50_000, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    entries, _, equal, total = links(docs, id_col, text_col, bucket_capacity, key_of)
    marked = with_hit(entries, "key", bit_table(equal, "key", equal.count()), "__hit")
    none = marked.where("NOT __hit").drop("__hit").withColumn("keep_id", F.col("id")).withColumn("group_size", F.lit(1).cast("bigint"))
    some = skewed_join(marked.where("__hit").drop("__hit"), equal, ["key", "sha"], F.col("group_size") > total // HOT_KEYS, "left")
    some = some.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
    out = none.unionByName(some)
    return out.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 50_000, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and a text (but for A-Z) one stays."""
    entries, _, equal, total = links(docs, id_col, text_col, bucket_capacity, key_of)
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.withColumn("__norm", norm).withColumn("__key", key_of(F.col("__norm"))).withColumn("__sha", F.unhex(F.sha2("__norm", 256))).drop("__norm")
    marked = with_hit(rows, "__key", bit_table(equal, "key", equal.count()), "__hit")
    alone = marked.where("NOT __hit")
    named = equal.select(F.col("key").alias("__key"), F.col("sha").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    met = skewed_join(marked.where("__hit"), named, ["__key", "__sha"], F.col("__size") > total // HOT_KEYS, "left")
    met = met.where(F.col("__size").isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col("__keep")))
    # Rows that repeat the kept id and its text are few where they occur; only then do texts meet again.
    repeats = skewed_join(entries, equal, ["key", "sha"], F.col("group_size") > total // HOT_KEYS).where(F.col("id").eqNullSafe(F.col("keep_id")))
    if repeats.groupBy("key", "sha").count().where("count > 1").limit(1).count():
        met = met.where("__size IS NULL").unionByName(met.where("__size IS NOT NULL").dropDuplicates(["__key", "__sha"]))
    return alone.select(*docs.columns).unionByName(met.select(*docs.columns))
