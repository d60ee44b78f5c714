"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: the sources share all words by weight; a source that would take more than `max_copies` times its own words is held
there and its excess goes to the others by weight. That is filling to a level: target = min(max_copies * words, level * weight),
and the level follows from running sums over the sources in the order of max_copies * words / weight.

Sampling: documents have unequal inclusion rates. A document of size s has the weight 8 + floor(log2(s)), so longer documents,
which cost the source more of its words a piece, are likelier than the shortest by up to a factor of three or so; its rate is
min(max_copies, scale * weight), with the scale at which the rates times the sizes of a source add up to its target. The whole
part of the rate are certain copies; the rest p is the inclusion probability of one more. Documents are ranked by their random
odds u / (1 - u) over the inclusion odds p / (1 - p) (Rosen's Pareto order sampling, u from a hash of the id, so reruns agree)
and taken in that order while their words fit what is left of the target: the size of the sample is fixed in words. The last
words are filled by the document that fits what remains best, `top_ups` times; only the last of them may go over the target, if
that is nearer.
The ranks use counted buckets instead of one window a source, so that a source with a third of all rows is spread out. Windows
over sources, and over a source's weights (64 at most), have one row for each.

Defined results: null text has size 0 and documents of size 0 are never taken; the null source is a source of its own, sorted
last; rows that repeat an id are separate documents, told apart by their text's hash and, if that is equal, interchangeable;
ties in the ranks go to the smaller id; a source's words all in documents too long for what is left of its target leave it short
by less than the shortest of them; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.shared import bucket_count, numbered, stored

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Rows (source, words, weight, target) from rows (source, size); as many as there are sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (place + 1).cast("int")))
    cap = max_copies * F.col("words")
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("ratio", cap.cast("double") / F.col("weight"))
    sources = sources.withColumn("free_words", F.sum("words").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    sources = sources.withColumn("free_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    sources = sources.withColumn("at", F.col("free_words").cast("double") / F.col("free_weight"))
    sources = sources.withColumn("level", F.min_by("at", F.when(F.col("at") <= F.col("ratio"), F.col("ratio"))).over(whole))
    return sources.select("source", "words", "weight", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def rates(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Rows (source, scale): the least scale at which min(max_copies, scale * weight) times the words adds up to the target."""
    t = targets.select(F.col("source").alias("t_source"), "target")
    rows = classes.join(t, classes["source"].eqNullSafe(t["t_source"]))
    by = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = F.coalesce(F.sum("words").over(before), F.lit(0)) * max_copies
    rows = rows.withColumn("scale", (F.col("target") - held.cast("double")) / F.sum(F.col("weight") * F.col("words")).over(rest).cast("double"))
    # The heaviest classes that reach max_copies are held there; the first split at which no other class does is the right one.
    return rows.where(F.col("scale") * F.col("weight") <= max_copies).groupBy("source").agg(F.max_by("scale", "weight").alias("scale"))


def mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_copies: int, seed: str, top_ups: int) -> DataFrame:
    """Rows (id, source, h, size, words, target, rate, copies)."""
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    weight = F.lit(8) + (F.length(F.bin("size")) - 1)
    # `row` tells rows apart that repeat an id and a text; which of them is taken makes no difference to the sums.
    sizes = stored(sizes.withColumn("weight", weight.cast("bigint")).withColumn("row", F.monotonically_increasing_id()))
    classes = stored(sizes.where("size > 0").groupBy("source", "weight").agg(F.sum("size").alias("words")))
    targets = stored(source_targets(sizes, weights, max_copies))
    scales = rates(classes, targets, max_copies).select(F.col("source").alias("r_source"), "scale")
    t = targets.select(F.col("source").alias("t_source"), "words", "target")
    t = stored(t.join(scales, t["t_source"].eqNullSafe(scales["r_source"]), "left").drop("r_source"))
    rows = sizes.join(t, sizes["source"].eqNullSafe(t["t_source"])).drop("t_source")
    rate = F.when(F.col("size") > 0, F.coalesce(F.least(F.lit(float(max_copies)), F.col("scale") * F.col("weight")), F.lit(float(max_copies)))).otherwise(0.0)
    # A rate of 0.9999999999 is one copy, not one that is nearly certain.
    rows = rows.withColumn("rate", rate).withColumn("whole", F.least(F.floor(F.col("rate") + 1e-9), F.lit(max_copies)).cast("bigint"))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    rows = rows.withColumn("u", (digits + F.lit(0.5)) / F.lit(float(2**52))).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("rank_key", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure")).select(F.col("source").alias("c_source"), "sure")
    rows = rows.join(certain, rows["source"].eqNullSafe(certain["c_source"])).drop("c_source")
    rows = rows.withColumn("left_words", F.col("target") - F.col("sure"))
    columns = ["id", "source", "h", "row", "size", "words", "target", "rate", "whole"]
    offered = F.coalesce(F.col("rank_key").isNotNull() & (F.col("left_words") > 0), F.lit(False))
    none = rows.where(~offered).select(*columns, F.lit(0).cast("bigint").alias("more"))
    n = bucket_count(sizes.count())
    # key / (1 + key) orders as the key does and lies between 0 and 1.
    pool = numbered(rows.where(offered), ["source"], F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * n), ["rank_key", "id", "h", "row"], n, "rank", add="size")
    pool = stored(pool.withColumn("more", (F.col("rank_sum") + F.col("size") <= F.col("left_words")).cast("bigint")).select(*columns, "left_words", "u", "more"))
    for k in range(top_ups):
        state = pool.groupBy("source").agg((F.first("left_words") - F.sum(F.col("more") * F.col("size"))).alias("gap"))
        gap = F.col("gap")
        there = pool["source"].eqNullSafe(F.col("s_source"))
        fits = pool.where("more = 0").join(state.withColumnRenamed("source", "s_source"), there).withColumn("miss", F.abs(gap - F.col("size"))).where((F.col("miss") < F.abs(gap)) & (F.lit(k + 1 == top_ups) | (F.col("size") <= gap)))
        best = fits.groupBy("source").agg(F.min(F.struct("miss", "u", "id", "h", "row")).alias("b")).select(F.col("b.row").alias("b_row"))
        pool = stored(pool.join(best, F.col("row") == F.col("b_row"), "left").withColumn("more", F.when(F.col("b_row").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("more"))).drop("b_row"))
    out = none.unionByName(pool.select(*columns, "more"))
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("bigint"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix", top_ups: int = 4) -> DataFrame:
    """One row per input row: id, size, source_size, target (of its source), taken (= copies * size), copies and rate (the expected copies)."""
    out = mixed(docs, id_col, text_col, source_col, weights, max_copies, seed, top_ups)
    return out.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix", top_ups: int = 4) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it (names that begin with two underscores may clash with its own)."""
    counts = mixed(docs, id_col, text_col, source_col, weights, max_copies, seed, top_ups)
    # Rows that repeat an id, a source and a text are told apart by a number; how many of them have k or more copies is all that is needed.
    more = [F.count_if(F.col("copies") >= k).alias(f"__{k}") for k in range(1, max_copies + 1)]
    plan = stored(counts.groupBy("id", "source", "h").agg(F.count(F.lit(1)).alias("__n"), *more))
    plan = plan.where("__1 > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("h").alias("__hash"), "__n", *[f"__{k}" for k in range(1, max_copies + 1)])
    here = F.col("__i").eqNullSafe(F.col("__id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__h") == F.col("__hash"))
    rows = docs.withColumns({"__i": F.col(f"`{id_col}`"), "__s": F.col(f"`{source_col}`"), "__h": F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0))})
    met = rows.join(plan.where("__n = 1"), here).withColumn("__rank", F.lit(0).cast("bigint"))
    repeated = plan.where("__n > 1")
    if repeated.limit(1).count():
        again = stored(rows.join(repeated, here).withColumn("__row", F.monotonically_increasing_id()))
        n = bucket_count(again.count())
        met = met.unionByName(numbered(again, ["__id", "__source", "__hash"], F.pmod(F.xxhash64("__row"), F.lit(n)), ["__row"], n, "__rank").drop("__row"))
    copies = sum((F.when(F.col("__rank") < F.col(f"__{k}"), 1).otherwise(0) for k in range(1, max_copies + 1)), F.lit(0))
    met = met.withColumn("__copies", copies).where("__copies > 0")
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
