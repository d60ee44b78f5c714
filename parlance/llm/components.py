"""Connected components of a graph in DataFrame operations: alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). A round passes the edges through few shuffles, because each
costs as many tasks as there are partitions, however small the graph. A node's whole neighbourhood is never gathered, only its minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.shared import stored


def ends(edges: DataFrame, first: tuple, second: tuple, names: tuple[str, str]) -> DataFrame:
    """Two rows for each edge, without reading the edges twice."""
    both = F.array(*[F.struct(*[c.alias(n) for c, n in zip(pair, names)]) for pair in (first, second)])
    return edges.select(F.explode(both).alias("e")).select("e.*")


def stars(edges: DataFrame) -> bool:
    """Whether the distinct edges (a, b), a above b, are stars around their smallest nodes: each a has one edge and is no b."""
    nodes = ends(edges, (F.col("a"), F.lit(1)), (F.col("b"), F.lit(0)), ("v", "up")).groupBy("v").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return nodes.where("ups > low").count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b), root being the smallest node of its component."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    low = F.min("b").over(Window.partitionBy("a"))
    for _ in range(max_rounds):
        if stars(edges):
            break
        # Large star: every neighbour above a node is tied to the smallest of the node and its neighbours.
        least = ends(edges, (F.col("a"), F.col("b")), (F.col("b"), F.col("a")), ("v", "m")).groupBy("v").agg(F.min("m").alias("m"))
        large = edges.join(least, F.col("b") == F.col("v")).select("a", F.least("v", "m").alias("b"))
        # Small star: a node's smaller neighbours, and the node, are tied to the smallest of them.
        small = ends(large.withColumn("m", low), (F.col("b"), F.col("m")), (F.col("a"), F.col("m")), ("a", "b"))
        edges = stored(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
