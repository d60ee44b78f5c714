"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors are dealt to blocks by their nearest pivot; each block's task builds a cover tree of its data and one of its queries and
searches them together. For a node pair with centres q, p and covering radii a, b no inner product is above
q.p + a |p| + b |q| + a b, so a pair is dropped once that is below the worst k-th score of the query group. The first round
searches each query's own block. The leaves of the queries' cover trees (`GROUP` queries at most) then are the groups: the same
bound on a group's and a block's centre and radius decides whether the group has to go to the block at all. A block meets
its groups in slices of `SLICE` queries, so no task gets more than one block and one slice. Leaves are compared as one matrix product.

Pivots are a bounded sample (`MAX_BLOCKS` vectors at most) and only decide where a vector lies; every row is indexed and the result is exact.
Scores are sums of products of integers in doubles as long as those are exact (below 2**53), and in 64-bit integers beyond.

Defined results: vectors that are null or hold nulls or non-finite components take no part, neither do rows without an id; a shorter
vector counts as ending in zeros, an empty one as all zeros; rows that repeat an id and a vector are one candidate and one query;
queries that share an id but not the vector are answered each for itself; a query's own row is every row with its id; with
fewer than k candidates all are returned; ties go to the smaller id, and rows that share an id and a score are one; components
times the scale lie below 2**53 and scores below 2**63; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.shared import stored

#: At most so many pivots, blocks and block summaries (64 doubles each: 4 MB) are sent to the tasks.
MAX_BLOCKS = 8192
LEAF = 128
#: Queries that are routed together, and that meet a block in one task.
GROUP, SLICE = 64, 4096
#: Pairs of blocks and slices that are sent whole to the tasks (8 bytes each); more are dealt by block.
MAX_PAIRS = 1 << 17
#: Relative room for rounding in the bounds.
SLACK = 1e-9
#: The score of no candidate.
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    """A node of a cover tree: its rows lie within `radius` of `centre`."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A cover tree: children's centres are at least half the parent's radius apart and cover it within that."""
    rows = np.arange(len(points)) if rows is None else rows
    top = Node(points[rows[0]], 0.0)
    todo = [(top, rows)]
    while todo:
        node, rows = todo.pop()
        far = np.sqrt(((points[rows] - node.centre) ** 2).sum(axis=1))
        node.radius = float(far.max()) * (1 + SLACK)
        if len(rows) <= leaf or node.radius == 0:
            node.rows = rows
            continue
        least, centre, left = node.radius / 2, node.centre, rows
        loose = []
        while len(left):
            near = np.sqrt(((points[left] - centre) ** 2).sum(axis=1)) <= least
            if near.sum() > leaf // 8 or near.all():
                child = Node(centre, least)
                node.children.append(child)
                todo.append((child, left[near]))
            else:  # small children are gathered in leaves of their own below
                loose.append(left[near])
            left = left[~near]
            if len(left):
                centre = points[left[0]]
            if len(loose) > 64 * (1 + len(node.children)):
                break  # too scattered for centres at this radius
        rest = np.concatenate([*loose, left]) if loose or len(left) else left
        for k in range(0, len(rest), leaf):
            part = rest[k : k + leaf]
            centre = points[part].mean(axis=0)
            radius = float(np.sqrt(((points[part] - centre) ** 2).sum(axis=1).max())) * (1 + SLACK)
            node.children.append(Node(centre, radius, part))
    return top


class Search:
    """The k best rows of `data` for each query, better than what `floor` already promises."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.query_ids, self.data, self.ids, self.k = queries, query_ids, data, ids, k
        self.scores = np.full((len(queries), k), NONE)
        self.best = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = floor
        most = [float(np.sqrt((x**2).sum(axis=1).max())) if len(x) else 0.0 for x in (queries, data)]
        self.kind = np.float64 if most[0] * most[1] < 2**53 else np.int64  # an inner product's partial sums stay below that
        self.queries_as, self.data_as = queries.astype(self.kind, copy=False), data.astype(self.kind, copy=False)

    def worst(self, rows: np.ndarray) -> float:
        low = float(np.maximum(self.scores[rows, -1], self.floor[rows]).min())
        return low - SLACK * abs(low)  # a double may lie above the integer

    def leaves(self, rows: np.ndarray, nodes: list[Node]) -> None:
        found = np.concatenate([x.rows for x in nodes])
        for a in range(0, len(found), 4096):
            part = found[a : a + 4096]
            ids = self.ids[part]
            score = (self.queries_as[rows] @ self.data_as[part].T).astype(np.int64)
            score[self.query_ids[rows][:, None] == ids[None, :]] = NONE
            score = np.concatenate([self.scores[rows], score], axis=1)
            ids = np.concatenate([self.best[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            order = np.lexsort((ids, ~score), axis=1)[:, : self.k]  # ~x orders as -x does, without overflow
            self.scores[rows], self.best[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def run(self, group: Node, nodes: list[Node], all_rows: np.ndarray | None = None) -> None:
        rows = group.rows if group.rows is not None else all_rows if all_rows is not None else gather(group)
        centres, radii = np.array([x.centre for x in nodes]), np.array([x.radius for x in nodes])
        bound = bounds(group.centre, group.radius, centres, radii)
        order = np.argsort(-bound, kind="stable")
        if group.rows is None:
            kept = [nodes[i] for i in order if bound[i] >= self.worst(rows)]
            for child in group.children if kept else ():
                self.run(child, kept)
            return
        k = 0
        while k < len(order):
            some = order[k : k + 8]
            k += len(some)
            kept = [nodes[i] for i in some if bound[i] >= self.worst(rows)]
            if not kept:
                return  # the others' bounds are lower still
            if leaves := [x for x in kept if x.rows is not None]:
                self.leaves(rows, leaves)
            if inner := [c for x in kept if x.rows is None for c in x.children]:
                self.run(group, inner)


def gather(node: Node) -> np.ndarray:
    todo, out = [node], []
    while todo:
        x = todo.pop()
        if x.rows is not None:
            out.append(x.rows)
        todo += x.children
    return np.concatenate(out)


def bounds(q: np.ndarray, a: float | np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Above any inner product of a point within a of q and one within b of p (rows of p), rounding included."""
    norm_q, norm_p = np.sqrt((q**2).sum(axis=-1)), np.sqrt((p**2).sum(axis=1))
    size = (norm_q[..., None] if q.ndim > 1 else norm_q) + (a[:, None] if q.ndim > 1 else a)
    bound = q @ p.T + (a[:, None] if q.ndim > 1 else a) * norm_p + b * (norm_q[:, None] if q.ndim > 1 else norm_q) + (a[:, None] if q.ndim > 1 else a) * b
    return bound + SLACK * (1 + size * (norm_p + b))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), width)


FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def found_table(query_ids: np.ndarray, query_keys: np.ndarray, search: Search) -> pa.Table:
    got = (search.scores > NONE) & (search.scores >= search.floor[:, None])
    spread = lambda x: pa.array(np.broadcast_to(x[:, None], got.shape)[got], pa.int64())
    return pa.table([spread(query_ids), spread(query_keys), pa.array(search.best[got], pa.int64()), pa.array(search.scores[got], pa.int64())], names=["query_id", "query_key", "vec_id", "score"])


def data_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (vector, id) of a block."""
    points, ids = matrix(table.column("v"), width), table.column("id").to_numpy()
    order = np.lexsort((*points.T, ids))
    points, ids = points[order], ids[order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (points[1:] != points[:-1]).any(axis=1))
    return points[new], ids[new]


def search_home(queries: pa.Table, data: pa.Table, k: int, width: int) -> pa.Table:
    """What each query of a block finds in its own block."""
    asked, query_ids = matrix(queries.column("v"), width), queries.column("id").to_numpy()
    points, ids = data_of(data, width)
    search = Search(asked, query_ids, np.full(len(asked), NONE), points, ids, k)
    if len(asked) and len(points):
        search.run(cover_tree(asked, leaf=GROUP), [cover_tree(points)])
    return found_table(query_ids, queries.column("key").to_numpy(), search)


def search_far(groups: pa.Table, data: pa.Table, k: int, width: int) -> pa.Table:
    """What groups of queries find in another block that is worth it."""
    flat = lambda c: groups.column(c).combine_chunks().flatten().to_numpy()
    query_ids, keys, floor, sizes = flat("ids"), flat("keys"), flat("floors"), groups.column("n").to_numpy()
    points, ids = data_of(data, width)
    search = Search(flat("vs").reshape(len(query_ids), width), query_ids, floor, points, ids, k)
    tree, start = [cover_tree(points)], 0
    for centre, radius, n in zip(matrix(groups.column("centre"), width), groups.column("radius").to_numpy(), sizes):
        search.run(Node(centre, float(radius), np.arange(start, start + n)), tree)
        start += n
    return found_table(query_ids, keys, search)


GROUPS = "slice int, block int, centre array<double>, radius double, n int, floor bigint, ids array<bigint>, keys array<bigint>, floors array<bigint>, vs array<double>"


def grouped(queries: pa.Table, width: int) -> pa.Table:
    """The leaves of a cover tree of a block's queries."""
    points = matrix(queries.column("v"), width)
    ids, keys, floors = (queries.column(c).to_numpy() for c in ("id", "key", "floor"))
    todo, rows = [cover_tree(points, leaf=GROUP)], []
    while todo:
        node = todo.pop()
        todo += node.children
        for a in range(0, 0 if node.rows is None else len(node.rows), GROUP):  # a leaf of equal vectors may be larger
            part = node.rows[a : a + GROUP]
            centre = points[part].mean(axis=0)
            radius = float(np.sqrt(((points[part] - centre) ** 2).sum(axis=1).max())) * (1 + SLACK)
            rows.append((0, queries.column("block")[0].as_py(), centre.tolist(), radius, len(part), int(floors[part].min()), ids[part].tolist(), keys[part].tolist(), floors[part].tolist(), points[part].ravel().tolist()))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in GROUPS.split(", ")])


def copied(points: DataFrame, sent: DataFrame) -> DataFrame:
    """The vectors of each block, once for each slice of queries that was routed to it (and for no other)."""
    pairs = stored(sent.select(F.col("block").alias("block"), F.col("slice").alias("slice")).distinct())
    return points.join(F.broadcast(pairs) if pairs.count() <= MAX_PAIRS else pairs, "block")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, rows_per_block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest integer inner products of each query with every other row."""
    spark = vectors.sparkSession
    raw = F.col(f"`{vector_col}`")
    whole = raw.isNotNull() & F.col(f"`{id_col}`").isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(whole).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), is_query.alias("asks"))
    facts = (rows := stored(rows)).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    total, width = facts["n"], facts["width"] or 1
    if total and facts["least"] < width:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    wanted = min(MAX_BLOCKS // 2, max(1, total // rows_per_block))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(wanted).collect()] or [[0.0] * width])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                at = (square - 2 * matrix(batch.column("v"), width) @ pivots.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "asks")), pa.array(at, pa.int32())], names=["id", "v", "asks", "pivot"])

    dealt = stored(rows.mapInArrow(nearest, "id bigint, v array<double>, asks boolean, pivot int"))
    # A pivot with too many rows (a vector that a third of all rows have) is split by a hash of the id.
    counts = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = max(rows_per_block * 4, 2 * -(-total // MAX_BLOCKS))
    slices, first, blocks = [], [], 0
    for p in range(len(pivots)):
        slices.append(max(1, -(-counts.get(p, 0) // limit)))
        first.append(blocks)
        blocks += slices[-1]
    plan = spark.createDataFrame([(p, first[p], slices[p]) for p in range(len(pivots))], "pivot int, first int, slices int")
    data = dealt.join(F.broadcast(plan), "pivot").select("id", "v", "asks", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("slices"))).cast("int").alias("block"))
    data = stored(data)

    def summary(table: pa.Table) -> pa.Table:
        points = matrix(table.column("v"), width)
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())) * (1 + SLACK)
        return pa.table({"block": table.column("block")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})

    known = data.select("block", "v").groupBy("block").applyInArrow(summary, "block int, centre array<double>, radius double").collect()
    number = np.array([r["block"] for r in known], np.int32)
    centres, radii = np.array([r["centre"] for r in known]).reshape(len(known), width), np.array([r["radius"] for r in known])

    asks = data.where("asks").select("id", F.xxhash64("v").alias("key"), "v", "block").dropDuplicates(["id", "key", "block"])
    points = data.select("block", "id", "v")
    near = stored(asks.groupBy("block").cogroup(points.groupBy("block")).applyInArrow(lambda q, d: search_home(q, d, k, width), FOUND))
    kth = near.groupBy("query_id", "query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = asks.join(kth, (asks["id"] == kth["query_id"]) & (asks["key"] == kth["query_key"]), "left")
    rest = rest.select("id", "key", "v", "block", F.coalesce("floor", F.lit(int(NONE))).alias("floor"))
    groups = stored(rest.groupBy("block").applyInArrow(lambda q: grouped(q, width), GROUPS))
    n_slices = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // SLICE))
    names = [x.split()[0] for x in GROUPS.split(", ")]

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low = batch.column("floor").to_numpy().astype(float)
            bound = bounds(matrix(batch.column("centre"), width), batch.column("radius").to_numpy(), centres, radii)
            go = (bound >= (low - SLACK * np.abs(low))[:, None]) & (number[None, :] != batch.column("block").to_numpy()[:, None])
            who, where = np.nonzero(go)
            for a in range(0, len(who), 512):
                part = batch.take(pa.array(who[a : a + 512]))
                yield pa.RecordBatch.from_arrays([part.column(c) if c != "block" else pa.array(number[where[a : a + 512]]) for c in names], names=names)

    sent = stored(groups.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(n_slices)).cast("int")).mapInArrow(routes, GROUPS))
    copies = copied(points, sent)
    far = sent.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInArrow(lambda g, d: search_far(g, d, k, width) if g.num_rows and d.num_rows else pa.table([pa.array([], pa.int64())] * 4, names=["query_id", "query_key", "vec_id", "score"]), FOUND)
    every = near.unionByName(far).groupBy("query_id", "query_key", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
