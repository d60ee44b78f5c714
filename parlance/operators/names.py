"""Names for accounts that come one after the other: a name that is taken gets the first free number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from parlance.operators.lineage import stored
from parlance.operators.scan import running

#: Slots and accounts of one bucket when they are numbered.
WIDTH = 4096
NUMBERED = r"^(.*)_([1-9]\d{0,17})$"


def named(base: Column, slot: Column) -> Column:
    return F.when(slot == 0, base).otherwise(F.concat(base, F.lit("_"), slot.cast("string")))


def split_name(name: Column) -> tuple[Column, Column]:
    """The base and the number of a name that a numbered slot would have; null for other names."""
    fits = F.regexp_like(name, F.lit(f"(?s){NUMBERED}"))
    return F.when(fits, F.regexp_extract(name, f"(?s){NUMBERED}", 1)), F.when(fits, F.regexp_extract(name, f"(?s){NUMBERED}", 2).cast("bigint"))


def by_id(rows: DataFrame) -> Column:
    """Ordered buckets of ids; one bucket where they aren't numbers."""
    return F.floor(F.col("id") / WIDTH) if isinstance(rows.schema["id"].dataType, NumericType) else F.lit(0)


def lost_slots(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(base, slot): the slots that no account of their base gets. Slot 0 of a base is its name, slot k is name_k.

    A base's accounts fill its slots upwards, in the order of ids. Besides names that are taken already, only slot 0 of another base
    `x_k` is in the way of slot k of `x`: its first account asks for it, whatever else happens. Slot k goes to `x` if its account that
    reaches k comes before that one, and which account does follows from how many slots below k are lost. So a pair is
    settled as soon as the slots below can't change it: `x` has it if it would with as few lost as are known, and hasn't if
    it wouldn't with all that are open lost as well. Each round settles the lowest open pair of each base at least, and usually all."""
    bases = stored(rows.groupBy("base").agg(F.min("id").alias("first")))
    x, k = split_name(F.col("name"))
    held = taken.select("name").distinct()
    held = held.select(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("slot")).unionByName(held.select(x.alias("base"), k.alias("slot")).where("base IS NOT NULL"))
    held = stored(held.join(bases.select("base"), "base", "left_semi").distinct())
    x, k = split_name(F.col("base"))
    pairs = bases.select(F.col("base").alias("other"), x.alias("base"), k.alias("slot"), "first").where("base IS NOT NULL").join(bases.select("base"), "base", "left_semi")
    pairs = pairs.join(held, ["base", "slot"], "left_anti")
    # How many accounts of a base come before the first one of the other.
    asked = rows.select("base", "id", F.lit(1).alias("n")).unionByName(pairs.select("base", F.col("first").alias("id"), F.lit(0).alias("n"), "slot", "other"), allowMissingColumns=True)
    early = running(asked, ["base"], by_id(rows), ["id"], {"early": F.col("n")}).where("n = 0").select("base", "slot", "other", "early")
    open_, fixed = stored(early), held.withColumn("lost", F.lit(1))
    while open_.count():
        below = fixed.unionByName(open_.select("base", "slot", F.lit(None).cast("int").alias("lost"), "other", "early"), allowMissingColumns=True)
        below = below.unionByName(open_.select(F.col("other").alias("base"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("lost")), allowMissingColumns=True)
        seen = running(stored(below), ["base"], F.floor(F.col("slot") / WIDTH), ["slot"], {"known": F.col("lost"), "unknown": F.col("lost").isNull().cast("int")}).where("other IS NOT NULL")
        has = F.when(F.col("slot") - F.col("known") < F.col("early"), True).when(F.col("slot") - F.col("known") - F.col("unknown") >= F.col("early"), False)
        judged = stored(seen.select("base", "slot", "other", "early", has.alias("has")))
        done = judged.where("has IS NOT NULL")
        fixed = fixed.unionByName(done.select("base", "slot", (~F.col("has")).cast("int").alias("lost")))
        fixed = stored(fixed.unionByName(done.select(F.col("other").alias("base"), F.lit(0).cast("bigint").alias("slot"), F.col("has").cast("int").alias("lost"))))
        open_ = stored(judged.where("has IS NULL").drop("has"))
    return fixed.where("lost = 1").select("base", "slot").distinct()


def unique_names(wanted: DataFrame, taken: DataFrame, longest: int = 60) -> DataFrame:
    """(id, name): in the order of ids, each account's wanted name (its first `longest` characters), or the first of name_1, name_2, … that nobody
    has at that time. `taken` (name) are the names that are there before. No group of equal names meets in one task."""
    rows = stored(wanted.select("id", F.substring("name", 1, longest).alias("base")))
    lost = stored(lost_slots(rows, taken))
    slot = F.floor(F.col("slot") / WIDTH)
    # A lost slot stands between the accounts that get the free slots below it and those that get the ones above.
    gaps = running(lost, ["base"], slot, ["slot"], {"lower": F.lit(1)}).select("base", (F.col("slot") - F.col("lower")).alias("at"), F.lit(0).alias("account"))
    nth = running(rows, ["base"], by_id(rows), ["id"], {"at": F.lit(1)}).select("base", "at", F.lit(1).alias("account"), "id")
    both = stored(nth.unionByName(gaps, allowMissingColumns=True))
    out = running(both, ["base"], F.floor(F.col("at") / WIDTH), ["at", "account"], {"skipped": F.lit(1) - F.col("account")}).where("account = 1")
    return out.select("id", named(F.col("base"), F.col("at") + F.col("skipped")).alias("name"))
