"""Sharding by balanced label propagation, in DataFrame operations only.

Law: `rows` - the shards' row counts are at most one apart. Links join documents of equal text; a group of n equal texts is a
star around its text, not n * (n - 1) / 2 edges, so all joins are by (text, shard) and a group is at most one row a shard in
the tables that are joined with the documents.
Each document starts in a shard given by a hash of its id. In each round every (text, shard) cell asks to join the fullest
cell of its text in another shard that has room; a shard's room is its quota of rows less the linked rows already in it.
Requests are admitted by gain until the room is used up; a cell that is admitted in part moves the documents whose hash lies
below its share. Documents without links cost nothing to move, so the last step fills the quotas exactly by moving rows out
of overfull shards, unlinked ones first.

A text with a third of all rows can't fit one shard; the propagation fills shards with it one after another.

Defined results: a null text counts as empty (size 1, crc 0) and is equal to empty texts; rows that repeat an id are separate
rows; ids may be null; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import HOT_KEYS, bit_table, bucket_count, numbered, skewed_join, stored, with_hit


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def propagate(linked: DataFrame, quota: int, shards: int, at_round: int, buckets: int) -> DataFrame:
    """One round over rows (id, text_key, h, shard): the same rows with new shards."""
    cells = stored(linked.groupBy("text_key", "shard").agg(F.count(F.lit(1)).alias("n")))
    used = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most `shards` rows
    room = [max(0, quota - used.get(s, 0)) for s in range(shards)]
    room_of = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in room]), F.col("shard") + 1)
    # The two fullest cells with room of each text: a cell never asks to join itself.
    open_cells = cells.where(room_of > 0).select("text_key", F.struct("n", (-F.col("shard")).alias("s")).alias("cell"))
    best = open_cells.groupBy("text_key").agg(F.max("cell").alias("to"))
    asks = cells.join(best, "text_key").where((F.col("to.s") != -F.col("shard")) & (F.struct("n", (-F.col("shard")).alias("s")) < F.col("to")))
    asks = asks.select("text_key", "shard", "n", (-F.col("to.s")).cast("int").alias("target"), (F.col("to.n") - F.col("n")).alias("gain"))
    steps = F.lit(8) - F.least(F.lit(8), F.floor(F.log2(F.col("gain") + F.lit(1.0)))).cast("int")
    spread = steps * buckets + F.pmod(F.xxhash64("text_key", F.lit(at_round)), F.lit(buckets))
    asks = numbered(asks, ["target"], spread, ["text_key", "shard"], buckets, "ask", add="n")
    free = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in room]), F.col("target") + 1)
    asks = asks.withColumn("share", F.greatest(F.lit(0), F.least(F.col("n"), free - F.col("ask_sum"))) / F.col("n")).where("share > 0")
    moves = stored(asks.select("text_key", "shard", "target", "share", "n"))
    out = skewed_join(linked, moves, ["text_key", "shard"], F.col("n") > sum(used.values()) // HOT_KEYS, "left")
    goes = F.coalesce(unit(F.col("id"), F.col("h"), F.lit(at_round)) < F.col("share"), F.lit(False))
    return stored(out.select("id", "text_key", "h", "size", "crc", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")))


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 6) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null under this law), linked."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("text_key"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    rows = stored(rows.withColumn("h", F.xxhash64("id", "text_key")).withColumn("shard", F.pmod(F.xxhash64("id", "text_key", F.lit("start")), F.lit(shards)).cast("int")))
    total = rows.count()
    quota, buckets = -(-total // shards), bucket_count(total)
    # Rows that a bounded filter of the linked texts rules out stay where they are; the others meet the linked texts.
    shared_texts = stored(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marked = with_hit(rows, "text_key", bit_table(shared_texts, "text_key", shared_texts.count()), "linked")
    met = stored(skewed_join(marked.where("linked"), shared_texts, ["text_key"], F.col("n") > total // HOT_KEYS, "left").withColumn("linked", F.col("n").isNotNull()).drop("n"))
    linked, alone = met.where("linked").drop("linked"), marked.where("NOT linked").unionByName(met.where("NOT linked"))
    for k in range(rounds):
        linked = propagate(linked, quota, shards, k, buckets)
    every = stored(alone.unionByName(linked.withColumn("linked", F.lit(True))))

    # Fill the quotas exactly. The tables of counts have one row a shard.
    have = {r["shard"]: r["count"] for r in every.groupBy("shard").count().collect()}
    want = [total // shards + (s < total % shards) for s in range(shards)]
    excess = [have.get(s, 0) - want[s] for s in range(shards)]
    per_shard = lambda xs, s: F.element_at(F.array(*[F.lit(x).cast("bigint") for x in xs]), s + 1)
    spread = F.col("linked").cast("int") * buckets + F.pmod(F.col("h"), F.lit(buckets))
    ranked = numbered(every, ["shard"], spread, ["h", "id"], buckets, "rank")
    leaves = F.col("rank") < per_shard(excess, F.col("shard"))
    offset, k = [], 0
    for x in excess:
        offset.append(k)
        k += max(0, x)
    place = per_shard(offset, F.col("shard")) + F.col("rank")
    into, k = F.lit(None).cast("int"), 0
    for s, x in enumerate(excess):
        if x < 0:
            into = F.when((place >= k) & (place < k - x), F.lit(s)).otherwise(into)
            k -= x
    placed = ranked.withColumn("shard", F.when(leaves, into).otherwise(F.col("shard")))
    out = numbered(placed, ["shard"], F.pmod(F.xxhash64("h"), F.lit(buckets)), ["id", "h"], buckets, "slot")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked",
    )


def cut_links(sharded: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many (text, shard) cells there are beyond one a text: the cut links of the stars. One row."""
    texts = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("t"))
    cells = sharded.join(texts, sharded[id_col].eqNullSafe(texts["id"])).groupBy("t", "shard").count()
    return cells.groupBy("t").agg((F.count(F.lit(1)) - 1).alias("cut")).agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"))
