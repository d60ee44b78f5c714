"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

Fingerprints are computed in Arrow batches. Equal fingerprints are one node from there on. Cut into five blocks, two
fingerprints that differ in at most three bits agree in at least two blocks, so each fingerprint has one key for each of the
ten pairs of blocks, and pairs that share a key are joined with the Hamming distance as a condition of the join.
A key that more than `group_limit` fingerprints share (templates, one text with many small edits) isn't joined with itself:
its fingerprints are cut again, into twelve blocks of which close pairs share at least nine; fingerprints that share such a
key differ in at most 16 places, so a group has at most 2**16 members, whatever the table's size, and is worked through in
one Arrow batch by looking up the neighbours within three bits. It emits links to one smaller neighbour at a time, not all
pairs. Both ways find every link that matters to the components.

Defined results: null and empty texts have no words and the fingerprint 0; texts of one or two words are one shingle; ties in
a bit (set in exactly half the hashes) are 0; component_id is the smallest non-null id reachable (null if there is none);
rows that repeat an id are separate rows; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components
from parlance.llm.shared import HOT_KEYS, skewed_join, stored

#: Shingles counted at once; bounds the memory that a very long text takes.
AT_ONCE = 1 << 15
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    found = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only and splits at \x20 and \x09-\x0D
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[: len(found) - words + 1].tolist()
    ends = (ends - 1)[words - 1 :].tolist()
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for k in range(0, n, AT_ONCE):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)  # big-endian digests: bit 63 first
        # Sums of 255 rows at most fit one byte.
        for j in range(0, len(bits), 255 * 64):
            part = bits[j : j + 255 * 64]
            whole = len(part) // 255 * 255
            counts += part[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if whole else 0
            counts += part[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of 64-bit hashes, as an unsigned integer: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):  # sums of 255 rows at most fit one byte
        raw = hashes[k : k + 255].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp), fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words, seed) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of blocks that two fingerprints within the distance may agree in, as signed integers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = (sum(c) for c in combinations(single, blocks - distance))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (fp, kind, key): the fingerprint's bits under each mask."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.kind", "k.key")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(values: np.ndarray, mask: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) among sorted fingerprints that are equal under `mask`: each to its nearest smaller values, by lookup."""
    free = [np.uint64(1) << np.uint64(i) for i in range(64) if not mask >> i & 1]
    flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for d in range(1, distance + 1) for c in combinations(free, d)]
    out_a, out_b = [], []
    if len(values) <= len(flips):  # then comparing is less work than looking up
        for k in range(1, len(values)):
            near = np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= distance)
            out_a.append(np.full(len(near), values[k]))
            out_b.append(values[near])
    else:
        for flip in flips:
            other = values ^ flip
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = (values[at] == other) & (other < values)
            out_a.append(values[hit])
            out_b.append(other[hit])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (out_a, out_b))
    # A forest has the same components as the links: follow each value's smallest known root.
    index_a, index_b, root = np.searchsorted(values, a), np.searchsorted(values, b), np.arange(len(values))
    while True:
        low = np.minimum(root[index_a], root[index_b])
        new = root.copy()
        np.minimum.at(new, index_a, low)
        np.minimum.at(new, index_b, low)
        np.minimum.at(new, root[index_a], low)
        np.minimum.at(new, root[index_b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    tied = np.flatnonzero(root != np.arange(len(values)))
    return values[tied], values[root[tied]]


def links(fps: DataFrame, distance: int = 3, group_limit: int = 128) -> DataFrame:
    """Edges (a, b) with the same components as all pairs of distinct fingerprints within the distance."""
    keys = keyed(fps, block_masks(distance + 2, distance))
    sizes = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys.join(sizes, ["kind", "key"]))
    few = keys.where(F.col("n") <= group_limit)
    x, y = few.select("kind", "key", F.col("fp").alias("a")), few.select("kind", "key", F.col("fp").alias("b"))
    same = (x["kind"] == y["kind"]) & (x["key"] == y["key"]) & (F.col("a") > F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance)
    pairs = x.join(y, same).select("a", "b")
    fine = block_masks(4 * distance, distance)

    def run(table: pa.Table) -> pa.Table:
        mask = fine[table.column("kind")[0].as_py()] & ((1 << 64) - 1)
        values = np.unique(table.column("fp").to_numpy().view(np.uint64))
        a, b = near_links(values, mask, distance)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    crowded = keys.where(F.col("n") > group_limit).select("fp").distinct()
    fine_keys = keyed(crowded, fine)
    groups = fine_keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "key")
    tied = fine_keys.join(groups, ["kind", "key"], "left_semi").groupBy("kind", "key").applyInArrow(run, "a bigint, b bigint")
    return pairs.unionByName(tied)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42, group_limit: int = 128) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, id_col, text_col, words, seed))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"), distance, group_limit)).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = rooted.where(F.col("fp") != F.col("root")).groupBy("root").agg(F.min("least").alias("low"))
    # Most components are one fingerprint; only the others meet in a join.
    named = rooted.join(named, "root", "left").select("fp", F.least("least", "low").alias("part"), "root", "n")
    head = named.where(F.col("fp") == F.col("root")).select("root", F.col("part").alias("component_id"))
    label = stored(named.select("fp", "root", "n").join(head, "root").select("fp", "component_id", "n"))
    total = label.agg(F.sum("n")).first()[0] or 0
    out = skewed_join(prints, label, ["fp"], F.col("n") > max(2000, total // HOT_KEYS))  # all empty texts, and all copies of one, share a fingerprint
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
