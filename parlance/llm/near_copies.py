"""Near copies at a Jaccard similarity of word shingles: SimHash first, exact similarity for links, MinHash bands for the rest.

Each distinct sequence of words is a node with a SimHash fingerprint of its shingles. As in `simhash.py`, equal fingerprints are one,
and pigeonhole blocks and the Hamming distance give those within `DISTANCE` bits; every candidate pair is verified by the shingle sets themselves
and the components of these links are formed. That finds the closest copies. A pair at 0.8 differs in about ten bits and seldom is
within three, and no link may be lost, so the components are then completed: each node's shingle hashes give `BANDS` band keys of
`ROWS` minima each, and nodes that share a key are candidates. A pair at 0.8 shares no key with probability (1 - 0.8**5)**28, about
0.000015, and more similar pairs less. First each node meets the smallest node of each of its groups, unless SimHash has joined
them already; then, within a group, nodes of different components meet, as far as they haven't. Pairs that are in one component
can't change it, so a group of many copies isn't compared with itself. Before sets are fetched for these, two bounds rule pairs
out, so that few but the links are left:
- Sets at 0.8 or more differ in a ninth of their sizes' sum at most. Each node has `PARITY` bits, a bit being the parity of the
  number of its shingles with that remainder; a shingle that only one set has flips one bit, so the sets differ in at least as many
  shingles as the bits differ. This loses no pair. It is sharp for sets of up to about `PARITY` shingles.
- Fewer than `AGREE` of the 140 minima in common; at 0.8 they share 112 on average, and fewer than 88 with a probability below 0.00001.

Defined results: words are lower-cased (A-Z) and split at white space; a text of at most `WORDS` words is one shingle, and texts without words are equal; of
each component the row with the smallest (id, words' hash) stays; rows without an id stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.bpe import slices
from parlance.llm.components import components
from parlance.llm.shared import HOT_KEYS, ascii_lower, bit_table, release, skewed_join, stored, with_hit
from parlance.llm.simhash import links, majority

WORDS, DISTANCE, BANDS, ROWS, AGREE, PARITY = 5, 3, 28, 5, 88, 2048
#: Nodes of a block of a group; blocks meet in one Arrow batch each.
BLOCK = 1024
#: Shingles hashed at once; bounds the memory that a very long text takes.
AT_ONCE = 1 << 12
_random = np.random.default_rng(42)
TIMES, PLUS = (_random.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
TIMES |= np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(found: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    joined, n = b" ".join(found), len(found)
    if n <= WORDS:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, n) + 1
    ends = np.cumsum(sizes)
    digest = xxhash.xxh3_64_intdigest
    pairs = zip((ends - sizes)[: n - WORDS + 1].tolist(), (ends - 1)[WORDS - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[s:e]) for s, e in pairs), np.uint64, n - WORDS + 1))


def band_keys(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """One signed 64-bit key for each band, and a byte of each minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, (hashes[k : k + AT_ONCE] * TIMES + PLUS).min(axis=1))
    raw, size = least.tobytes(), 8 * ROWS
    keys = np.array([xxhash.xxh3_64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist(), (least >> np.uint64(8) & np.uint64(255)).astype(np.uint8).tobytes()


def parity(hashes: np.ndarray) -> bytes:
    """The number of shingles (32 bits), then the parity bits."""
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.int32(len(hashes)).tobytes() + np.packbits(odd.astype(bool)).tobytes()


def may_link(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Which pairs (of a sketch in x, one in y; as a table) of sketches (minima, number, parity bits) the two bounds leave."""
    at, width = BANDS * ROWS, BANDS * ROWS + 4 + PARITY // 8
    one, two = (np.frombuffer(b"".join(side), np.uint8).reshape(-1, width) for side in (x, y))
    n_one, n_two = (np.ascontiguousarray(side[:, at : at + 4]).view(np.int32)[:, 0].astype(np.int64) for side in (one, two))
    bits_one, bits_two = (np.ascontiguousarray(side[:, at + 4 :]).view(np.uint64) for side in (one, two))
    out = np.zeros((len(one), len(two)), bool)
    for i in range(len(one)):
        near = np.flatnonzero((two[:, :at] == one[i, :at]).sum(axis=1) >= AGREE)
        differ = np.bitwise_count(bits_two[near] ^ bits_one[i]).sum(axis=1, dtype=np.int64)
        out[i, near] = 9 * differ <= n_two[near] + n_one[i]
    return out


def with_nodes(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with their node as a column: a digest of the sequence of words, made in the JVM."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), r"[ \t\n\x0B\f\r]+", " ")
    return docs.withColumn("__node", F.substring(F.unhex(F.sha2(F.trim(spaced), 256)), 1, 16))


def node_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, node, fp, keys, sketch); fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            prints, keys, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(words_of(text))
                found, minima = band_keys(hashes)
                prints.append(majority(hashes))
                keys.append(found)
                sketches.append(minima + parity(hashes))
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), fps, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "node", "fp", "keys", "sketch"])
            release()

    rows = with_nodes(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")), "text").withColumnRenamed("__node", "node")
    return rows.mapInArrow(run, "id bigint, node binary, fp bigint, keys array<bigint>, sketch binary")


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) from distinct nodes (node, fp): nodes of one fingerprint with its smallest node, and the smallest
    nodes of fingerprints that SimHash's blocks and the Hamming distance tie."""
    leads = stored(prints.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")))
    limit = max(2000, (leads.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    same = skewed_join(prints, leads.where("n > 1"), ["fp"], F.col("n") > limit).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    x, y = leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    tied = links(leads.select("fp"), DISTANCE).distinct().join(x, "a").join(y, "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return same.unionByName(tied).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes aren't in one component of `roots` (node, root)."""
    x = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).join(roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    counts = stored(counts)
    limit = max(2000, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    met = skewed_join(pairs, counts, ["b"], F.col("n") > limit).join(x, "a", "left")
    return met.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets, of `sets` (node, hashes), have a Jaccard similarity of 0.8 or more."""
    # A node that very many pairs share has its set sent to several tasks; there are at most HOT_KEYS such nodes.
    shared = stored(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    limit = max(2000, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(shared.where(F.col("n") > limit).select("b", F.ceil(F.col("n") / limit).alias("slices")))
    pairs = pairs.join(hot, "b", "left").withColumn("slice", F.pmod(F.xxhash64("a"), F.coalesce("slices", F.lit(1)))).drop("slices")
    x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    y = y.join(hot, "b", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    met = pairs.join(x, "a").join(y, ["b", "slice"])
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.when(5 * small >= 4 * large, F.size(F.array_intersect("x", "y"))).otherwise(0)  # sets of too different sizes can't be similar
    return met.where(5 * both >= 4 * (small + large - both)).select("a", "b")


def compared(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that the bounds leave, from (key, node, root, main, sketch) of open groups.

    The nodes outside a group's main component meet all of the group. Both sides are dealt to blocks of about BLOCK nodes, a
    group of a third of all rows to as many as it needs, and each two blocks are compared inside a task: what leaves it are the
    pairs that pass, and no pair is a row before that."""
    out = F.col("root") != F.col("main")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count_if(out).alias("less"))
    blocks = counts.select("key", F.ceil(F.col("less") / BLOCK).cast("int").alias("n_less"), F.ceil(F.col("all") / BLOCK).cast("int").alias("n_all"))
    wide = F.broadcast(blocks.where("n_all > 1"))  # more than BLOCK rows each, so a thousandth of the rows at most
    rows = members.join(wide, "key", "left").withColumns({"n_less": F.coalesce("n_less", F.lit(1)), "n_all": F.coalesce("n_all", F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("bigint")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    less = rows.where(out).select("key", own("n_less").alias("i"), each("n_all").alias("j"), F.lit(True).alias("less"), "node", "root", "sketch")
    every = rows.select("key", each("n_less").alias("i"), own("n_all").alias("j"), F.lit(False).alias("less"), "node", "root", "sketch")

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("less").to_numpy()
        one, two = table.filter(pa.array(side)), table.filter(pa.array(~side))
        nodes, others = one.column("node").to_pylist(), two.column("node").to_pylist()
        roots, other_roots = np.array(one.column("root").to_pylist(), object), np.array(two.column("root").to_pylist(), object)
        i, j = np.nonzero(may_link(one.column("sketch").to_pylist(), two.column("sketch").to_pylist()))
        apart = roots[i] != other_roots[j] if len(i) else np.zeros(0, bool)
        pairs = [(max(nodes[x], others[y]), min(nodes[x], others[y])) for x, y in zip(i[apart].tolist(), j[apart].tolist())]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    return less.unionByName(every).groupBy("key", "i", "j").applyInArrow(meet, "a binary, b binary")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = stored(node_rows(docs, id_col, text_col))
    # Nodes are distinct before they meet; a node's keys are the same in each of its rows.
    distinct = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    near = stored(simhash_pairs(stored(distinct.select("node", "fp"))))
    keyed = stored(distinct.select("node", F.explode("keys").alias("key")))
    groups = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    limit = max(2000, keyed.count() // BANDS // HOT_KEYS)
    groups, many = stored(groups), F.col("n") > limit  # BANDS * HOT_KEYS such groups at most
    members = stored(skewed_join(keyed, groups, ["key"], many))
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = [shingles(words_of(t)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])
            release()

    met = stored(members.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    # Only texts that a bounded filter of these nodes lets pass are moved.
    texts = with_nodes(docs.select(F.col(f"`{text_col}`").alias("text")), "text").select(F.col("__node").alias("node"), "text")
    texts = with_hit(texts, "node", bit_table(met, "node", met.count()), "hit").where("hit").drop("hit")
    sets = stored(texts.join(met, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(hashed, "node binary, hashes array<bigint>"))
    roots = components(verified(near, sets))
    # What SimHash hasn't joined: each node meets the smallest of each of its groups.
    tested = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    tested = stored(apart(stored(tested.join(near, ["a", "b"], "left_anti")), roots))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(tested, sets)))
    # What is left: nodes of one group that aren't in one component, and haven't met.
    labelled = stored(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mains = parts.groupBy("key").agg(F.max_by("root", "c").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mains = stored(mains.join(groups.select("key", F.col("n").alias("all")), "key"))
    open_groups = stored(skewed_join(labelled.where("n > 2 AND node <> lead"), mains, ["key"], F.col("all") > limit).drop("all"))
    sketches = rows.select("node", "sketch").dropDuplicates(["node"])
    open_groups = stored(open_groups.join(sketches, "node"))
    cross = stored(compared(open_groups).distinct().join(tested.unionByName(near), ["a", "b"], "left_anti"))
    more = verified(cross, sets)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = rows.where("id IS NOT NULL").select("id", "node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = stored(named.join(least, "root").where("id <> least.id OR node <> least.node").select(F.col("id").alias("__gone"), F.col("node").alias("__gone_node")))
    marked = with_hit(with_nodes(docs, text_col), "__node", bit_table(gone, "__gone_node", gone.count()), "__hit")
    here = (F.col(f"`{id_col}`") == F.col("__gone")) & (F.col("__node") == F.col("__gone_node"))
    left = marked.where("__hit").join(gone, here, "left_anti")
    return marked.where("NOT __hit").unionByName(left).select(*docs.columns)
