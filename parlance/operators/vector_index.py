"""A stored inverted-file index for nearest neighbours: rows lie in one folder a cell, and a question reads only cells that can matter.

Cells are the nearest of a few centroids, learnt by k-means on a bounded sample; every row is indexed. For each cell (and level) the
index keeps how near and how far its rows are from the centroid, which bounds a question's distance to them. A search first reads the
cells around the question until they hold k rows, and then those whose bound can beat the k-th distance found; distances are
exact, so the answer is that of a comparison with all rows.

Defined results: rows without a vector, with a null or non-finite entry or of another length than the first centroid's aren't indexed; a vector of
length zero is at distance 1 from everything (cell -1); questions of these kinds get no rows, but one of length zero gets the k smallest
ids; equal distances (to nine decimals) go by id; a level without rows means all levels; an index of no rows answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from parlance.functions.vector import relevance_pct
from parlance.operators.lineage import stored
from parlance.operators.nearest import Best, gather, pairs, questions, ranked

#: At most so many centroids, and so many sampled rows a centroid, are held by the driver and sent to tasks.
MAX_CELLS = 1024
SAMPLE = 32
#: Rows of a cell's file.
FILE_ROWS = 200_000
#: Distances are compared to nine decimals.
SLACK = 1e-8
#: Folder names begin with it, so that no level is read as a number.
ANY = "-"


def matrix(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of `dims` finite entries (of the first row's length if None), and these at length 1 (zeros stay)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    dims = dims or int(sizes[sizes > 0][0]) if (sizes > 0).any() else dims or 1
    ok = sizes == dims
    flat = column.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(flat).all(axis=1)
    ok[np.flatnonzero(ok)[~fine]] = False
    x = flat[fine]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return ok, np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids(docs: DataFrame, id_col: str, cells: int | None, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over at most SAMPLE rows a cell, picked by a hash of their id."""
    n = docs.where("embedding IS NOT NULL").count()
    cells = min(MAX_CELLS, max(1, cells or int(n**0.5)))
    most = cells * SAMPLE
    share = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) <= (1 << 20) * min(1.0, 1.2 * most / max(n, 1))
    some = docs.where(share & (F.size("embedding") > 0)).select("embedding").limit(most).toArrow().column(0).combine_chunks()
    x = matrix(some)[1] if len(some) else np.zeros((0, 1))
    x = x[np.abs(x).sum(axis=1) > 0]
    if not len(x):
        return np.zeros((0, max(1, x.shape[1])))
    rng = np.random.default_rng(seed)
    at = x[np.sort(rng.permutation(len(x))[:cells])]
    for _ in range(rounds):
        near = (x @ at.T).argmax(axis=1)
        for c in range(len(at)):
            mean = x[near == c].sum(axis=0) if (near == c).any() else np.zeros(x.shape[1])
            if (size := np.linalg.norm(mean)) > 0:
                at[c] = mean / size
    return at


def build(docs: DataFrame, path: str, id_col: str = "vec_id", level_col: str | None = None, cells: int | None = None, seed: int = 7) -> None:
    """Write the index of `docs` (id, embedding, a level if there is one) to a new folder: rows/level=/cell=, and the table of cells."""
    at = centroids(docs, id_col, cells, seed)
    dims = at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = matrix(batch.column("embedding"), dims)
            some = batch.filter(pa.array(ok))
            cell, far = np.full(len(x), -1), np.zeros(len(x))
            lies = np.abs(x).sum(axis=1) > 0
            if len(at) and lies.any():
                cell[lies] = (x[lies] @ at.T).argmax(axis=1)
                far[lies] = np.linalg.norm(x[lies] - at[cell[lies]], axis=1)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[*some.schema.names, "cell", "far"])

    level = F.concat(F.lit(ANY), F.coalesce(F.col(level_col).cast("string"), F.lit(""))) if level_col else F.lit(ANY)
    rows = docs.select(F.col(id_col).alias("id"), "embedding", level.alias("level"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stored(rows.mapInArrow(run, f"{kinds}, cell int, far double"))
    facts = placed.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("nearest"), F.max("far").alias("farthest"))
    table = docs.sparkSession.createDataFrame([(c, v.tolist()) for c, v in enumerate(at)] + [(-1, [0.0] * dims)], "cell int, centroid array<double>")
    facts = stored(facts.join(table, "cell"))
    facts.write.parquet(f"{path}/cells")
    # A cell that very many rows share gets several files, each written by a task of its own.
    parts = facts.select("level", "cell", F.ceil(F.col("n") / FILE_ROWS).alias("files"))
    split = placed.join(F.broadcast(parts), ["level", "cell"]).withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))
    split.repartition("level", "cell", "file").select("id", "embedding", "level", "cell").write.partitionBy("level", "cell").parquet(f"{path}/rows")


class Map(NamedTuple):
    """The index's cells as a question's task needs them; `place` is a cell's place among all cells of the index, of which there are `total`."""

    place: np.ndarray
    total: int
    cell: list[int]
    n: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    centroid: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's centroid distance from a question of length 1 (or 0), and the least cosine distance that its rows can have."""
        if not q.any():
            return np.zeros(len(self.n)), np.zeros(len(self.n))
        away = np.linalg.norm(self.centroid - q, axis=1)
        least = np.maximum(0, np.maximum(away - self.farthest, self.nearest - away))
        zero = np.array(self.cell) < 0
        return np.where(zero, np.sqrt(2), away), np.where(zero, 1.0, least * least / 2)


def all_cells(spark: SparkSession, path: str) -> list[Row]:
    """The index's cells in the order of their places."""
    return spark.read.parquet(f"{path}/cells").orderBy("level", "cell").collect()


def cell_map(spark: SparkSession, path: str, level: str | None) -> Map | None:
    """The cells of a level, or of all if it has none; a row for each level and cell, so their number is bounded."""
    cells = list(enumerate(all_cells(spark, path)))
    found = [(n, r) for n, r in cells if level is not None and r.level == ANY + level] or cells
    if not found:
        return None
    return Map(np.array([n for n, _ in found]), len(cells), [r.cell for _, r in found], *(np.array([r[c] for _, r in found], float) for c in ("n", "nearest", "farthest", "centroid")))


def route(queries: DataFrame, cells: Map, k: int, kth: bool) -> DataFrame:
    """(query_id, q, kth, cells: one bit a cell of the index): with `kth` (a column of `queries`, null if k rows weren't found) the cells
    that can still matter, else the nearest that hold k rows. Questions without cells are left out."""
    dims = cells.centroid.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = matrix(batch.column("q"), dims)
            some, bits = [], []
            limits = batch.column("kth").to_pylist()
            for at, q in zip(np.flatnonzero(ok).tolist(), x):
                away, least = cells.bounds(q)
                order = np.argsort(away, kind="stable")
                first = order[: 1 + int(np.searchsorted(np.cumsum(cells.n[order]), k))]
                can = np.zeros(len(order), bool)
                if kth:
                    can = least <= (np.inf if limits[at] is None else limits[at] + SLACK)
                can[first] = not kth
                if can.any():
                    mine = np.zeros(cells.total, bool)
                    mine[cells.place[can]] = True
                    some.append(at)
                    bits.append(np.packbits(mine).tobytes())
            kept = batch.take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bits, pa.binary())], names=[*kept.schema.names, "cells"])

    rows = queries.select("query_id", "q", F.col("kth") if kth else F.lit(None).cast("double").alias("kth"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cells binary")


def opened(column: pa.Array, total: int) -> np.ndarray:
    """Which cells (columns) each route (row) has."""
    width = -(-total // 8)
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)
    return np.unpackbits(packed, axis=1, count=total).astype(bool)


def meet(spark: SparkSession, path: str, routes: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each question in its cells. Only their folders are listed and read.

    A block of questions is sent to the rows, as in `operators/nearest.py`; a cell's rows meet the questions that go there."""
    cells = all_cells(spark, path)
    place, cores = {(r.level, r.cell): n for n, r in enumerate(cells)}, spark.sparkContext.defaultParallelism
    rows = spark.read.parquet(f"{path}/rows")
    kinds = f"query_id {routes.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, far double"

    def look(table: pa.Table) -> tuple[DataFrame, Broadcast]:
        wanted = [cells[n] for n in np.flatnonzero(opened(table.column("cells"), len(cells)).any(axis=0))]
        folders = F.lit(False)
        for level, mine in groupby(wanted, lambda r: r.level):
            folders |= (F.col("level") == level) & F.expr(f"cell IN ({', '.join(str(r.cell) for r in mine)})")
        some = rows.where(folders)
        # Many small files; a task of several keeps k rows a question for all of them.
        some = some.coalesce(max(2 * cores, sum(r.n for r in wanted) // FILE_ROWS)).select("id", "embedding", "level", "cell")
        sent = spark.sparkContext.broadcast(table)
        return some.mapInArrow(lambda batches: read_cells(batches, sent, place, k), kinds), sent

    return gather(routes, k, look)


def read_cells(batches: Iterator[pa.RecordBatch], sent: Broadcast, place: dict[tuple[str, int], int], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of this task's rows (id, embedding, level, cell) for each question sent (query_id, q, kth, cells): (query_id, id, far)."""
    table = sent.value
    names, groups = questions(table)
    if not groups:
        return
    ((at, asked),) = groups.values()  # all have the index's width, or they would have no route
    goes = np.ascontiguousarray(opened(table.column("cells"), len(place))[at].T)
    best = Best(asked, k, table.column("kth").to_numpy()[at].astype(float))
    for batch in batches:
        levels = batch.column("level").dictionary_encode()
        where = levels.indices.to_numpy().astype(np.int64) << 32 | (batch.column("cell").to_numpy() + 1)
        for code in np.unique(where).tolist():
            mine = np.flatnonzero(where == code)
            to = np.flatnonzero(goes[place[levels.dictionary[code >> 32].as_py(), (code & 0xFFFFFFFF) - 1]])
            best.add(batch.column("id"), batch.column("embedding"), mine, to)
    q, far, ids = best.merge()
    if len(q):
        yield pairs(names, at[q], ids, pa.array(far))


def cells_read(spark: SparkSession, path: str, routes: DataFrame) -> DataFrame:
    """(query_id, level, cell) of routes."""
    cells = all_cells(spark, path)
    level, cell = pa.array([r.level for r in cells], pa.string()), pa.array([r.cell for r in cells], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (pa.array(x) for x in np.nonzero(opened(batch.column("cells"), len(cells))))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), level.take(n), cell.take(n)], names=["query_id", "level", "cell"])

    rows = routes.select("query_id", "cells")
    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, level string, cell int")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, level: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest rows (query_id, rank, id, distance, relevance) of `queries` (query_id, q), and the cells that each question read (query_id, level, cell)."""
    cells = cell_map(spark, path, level)
    if cells is None:
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank bigint, id bigint, distance double, relevance bigint"), spark.createDataFrame([], f"query_id {kind}, level string, cell int")
    asked = queries.select("query_id", "q")
    first = stored(route(asked, cells, k, False))
    near = stored(meet(spark, path, first, k))
    kth = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    more = stored(route(asked.join(kth, "query_id", "left"), cells, k, True))
    found = ranked(near.drop("rank").unionByName(meet(spark, path, more, k).drop("rank")), k)
    answer = found.select("query_id", "rank", "id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), relevance_pct(F.col("distance")).alias("relevance"))
    return answer, cells_read(spark, path, first.unionByName(more))
