"""Running values and successor paths over ordered rows, without one task a key.

`running` deals the rows of a key to ordered buckets; what comes before a bucket is added to it as one row more, so each bucket is
summed by itself. `orbit` marks the places that a path of successors visits: inside a block of places by doubling arrays of
successors, between blocks by doubling joins, so a path of n steps takes about log n rounds and no task sees a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.lineage import stored

#: Places of a block.
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS


def running(df: DataFrame, part: list[str], bucket: Column, order: list, sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """`df` with, for each row, the sum of the rows before it in its part (`sums`, 0 for the first) and their greatest value (`tops`, null
    if there is none). A top of struct(place, value) is the last value before the row. `bucket` has to be ordered as `order` is. Nulls in `part` are one part."""
    sums, tops = sums or {}, tops or {}
    rows = df.withColumns({"__bucket": bucket, **{f"__{n}": F.coalesce(c, F.lit(0)).cast("bigint") for n, c in sums.items()}, **{f"__{n}": c for n, c in tops.items()}})
    totals = rows.groupBy(*part, "__bucket").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums], *[F.max(f"__{n}").alias(f"__{n}") for n in tops])
    earlier = Window.partitionBy(*part).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*part, "__bucket", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums], *[F.max(f"__{n}").over(earlier).alias(f"__{n}") for n in tops], F.lit(0).alias("__row"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(*part, "__bucket").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, -1)
    found = {**{n: F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)) for n in sums}, **{n: F.max(f"__{n}").over(before) for n in tops}}
    return both.select("*", *[c.alias(f"__of_{n}") for n, c in found.items()]).where("__row = 1").select(*[c for c in df.columns if c not in found], *[F.col(f"__of_{n}").alias(n) for n in found])


def lookahead(rows: DataFrame, reach: int, width: int, behind: int = 0) -> DataFrame:
    """`rows` (at, …) by blocks of `width`, each with copies of the rows up to `reach` ahead of it and up to `behind` before it (core is false)."""
    block = F.floor(F.col("at") / width).cast("bigint")
    offset = F.col("at") - block * width
    near = F.array(block, *[F.when(offset <= reach, block - 1)], *([F.when(width - offset <= behind, block + 1)] if behind else []))
    out = rows.withColumn("own", block).withColumn("block", F.explode(F.array_compact(near)))
    return out.withColumn("core", F.col("own") == F.col("block")).drop("own")


def same(a: DataFrame, b: DataFrame, part: list[str]) -> Column:
    out = F.lit(True)
    for p in part:
        out = out & a[p].eqNullSafe(b[p])
    return out


def orbit(steps: DataFrame, part: list[str]) -> DataFrame:
    """(part, pos): the places reached from place 0 of each part. `steps` (part, pos, next) has a row for each place from 0, next > pos;
    a path ends where `next` has no row."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("next").cast("bigint").alias("next")))), lambda s: s.next)
    blocks = stored(steps.groupBy(*part, F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")).agg(listed.alias("to")))
    base = F.col("block") * BLOCK
    rounds = F.sequence(F.lit(1), F.lit(BLOCK_BITS))
    twice = lambda to: F.transform(to, lambda x: F.coalesce(F.get(to, (x - base).cast("int")), x))
    one = blocks.agg(F.max("block").alias("b")).first().b
    if not one:
        entries = blocks.select(*part, "block", F.lit(0).cast("bigint").alias("entry"))
    else:
        last = F.aggregate(rounds, F.col("to"), lambda to, _: twice(to))
        leave = blocks.select(*part, F.posexplode(last).alias("k", "exit"), base.alias("base")).select(*part, (F.col("base") + F.col("k")).alias("pos"), "exit")
        begins = blocks.where("block = 0").select(*part, F.lit(0).cast("bigint").alias("pos"))
        heads = leave.select(*part, F.col("exit").alias("pos")).distinct().unionByName(begins)
        jump = stored(leave.join(heads, same(leave, heads, part) & (leave["pos"] == heads["pos"]), "left_semi"))
        reached = begins
        while True:
            a, b = reached.alias("a"), jump.alias("b")
            far = a.join(b, same_named("a", "b", part) & (F.col("a.pos") == F.col("b.pos"))).select(*[F.col(f"a.{p}") for p in part], F.col("b.exit").alias("pos"))
            more = stored(far)
            if not more.count():
                break
            reached = stored(reached.unionByName(more))
            c = jump.alias("c")
            jump = stored(c.join(b, same_named("c", "b", part) & (F.col("c.exit") == F.col("b.pos"))).select(*[F.col(f"c.{p}") for p in part], F.col("c.pos"), F.col("b.exit")))
        entries = reached.select(*part, F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block"), F.col("pos").alias("entry"))
    a, b = blocks.alias("a"), entries.alias("b")
    met = a.join(b, same_named("a", "b", part) & (F.col("a.block") == F.col("b.block"))).select(*[F.col(f"a.{p}") for p in part], "a.block", "a.to", "b.entry")
    inside = lambda x: (x >= base) & (x < base + F.size("to"))
    start = F.struct(F.array("entry").alias("seen"), F.col("to").alias("to"))
    walk = F.aggregate(rounds, start, lambda s, _: F.struct(F.concat(s.seen, F.filter(F.transform(s.seen, lambda x: F.get(s.to, (x - base).cast("int"))), inside)).alias("seen"), twice(s.to).alias("to")), lambda s: s.seen)
    return met.where("entry >= block * {0} AND entry < block * {0} + size(to)".format(BLOCK)).select(*part, F.explode(walk).alias("pos"))


def same_named(a: str, b: str, part: list[str]) -> Column:
    out = F.lit(True)
    for p in part:
        out = out & F.col(f"{a}.{p}").eqNullSafe(F.col(f"{b}.{p}"))
    return out
