"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.lineage import shared_dir, stored  # noqa: F401

#: glibc's call that gives freed pages back; other C libraries don't have it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what this worker has freed back to the system: it is used again, for other operators too, and waits with what it holds."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other than ASCII characters take the built-in's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(df: DataFrame, part: list[str], spread: Column, order: list, buckets: int, name: str, add: str | None = None) -> DataFrame:
    """Running row number (from 0) and, with `add`, running sum before each row, of the rows of each `part`.

    One window over a `part` would send all its rows to one task. Here `spread` deals the rows of a part to `buckets`
    ordered buckets; their counts are summed over the buckets first (few rows), then each bucket is numbered by itself.
    `spread` has to be ordered as `order` is, or the order only holds within a bucket.
    Adds `<name>` and, with `add`, `<name>_sum`.
    """
    b, n, s = f"__{name}_bucket", f"__{name}_n", f"__{name}_s"
    df = df.withColumn(b, spread)
    before = Window.partitionBy(*part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*part, b).agg(F.count(F.lit(1)).alias(n), F.sum(F.col(add) if add else F.lit(0)).alias(s))
    names = {c: f"__{name}_of_{c}" for c in [*part, b]}
    counts = counts.select(*[F.col(c).alias(x) for c, x in names.items()], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n), F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s))
    same = F.col(b) == F.col(names[b])
    for c in part:
        same = same & F.col(c).eqNullSafe(F.col(names[c]))
    out = df.join(counts, same).drop(*names.values())
    within = Window.partitionBy(*part, b).orderBy(*order)
    out = out.withColumn(name, F.col(n) + F.row_number().over(within) - 1)
    if add:
        rows = within.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"{name}_sum", F.col(s) + F.coalesce(F.sum(add).over(rows), F.lit(0)))
    return out.drop(b, n, s)


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """Buckets for `numbered`: a bucket of a part that holds all rows has about `per_bucket` of them."""
    return max(least, -(-rows // per_bucket))


#: A broadcast bit table has at most so many words of 64 bits (16 bytes a row).
MAX_WORDS = 1 << 19
#: A key with more than this share of all rows is hot; there are at most so many such keys.
HOT_KEYS = 1000


def bit_of(key: Column, words: int) -> tuple[Column, Column]:
    """Word and bit of a key in a table of `words` words."""
    h = F.xxhash64(key, F.lit(7))
    return F.pmod(F.shiftright(h, 6), F.lit(words).cast("bigint")), h.bitwiseAND(F.lit(63)).cast("int")


def bit_table(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Rows (word, bits) of a filter over about `n` keys, and its size: eight or more bits a key up to the limit, beyond which more pass it."""
    words = 1 << min(MAX_WORDS.bit_length() - 1, max(6, (n // 4).bit_length()))
    word, bit = bit_of(F.col(key), words)
    rows = keys.select(word.alias("__word"), bit.alias("__bit"))
    return stored(rows.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))), words


def with_hit(df: DataFrame, key: str, table: tuple[DataFrame, int], name: str) -> DataFrame:
    """`df` with the column `name`: false where the key isn't among the table's keys for certain."""
    bits, words = table
    word, bit = bit_of(F.col(key), words)
    out = df.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(bits), "__word", "left")
    return out.withColumn(name, F.coalesce(F.getbit("__bits", F.col("__bit")) == 1, F.lit(False))).drop("__word", "__bit", "__bits")


def skewed_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """`rows` joined with `side`, which has a key once. Keys that `hot` (a condition on `side`) names, HOT_KEYS at most, are sent
    to the rows; only the other rows are dealt by key, so no task gets all rows of a hot key."""
    side = side.withColumn("__hot", F.coalesce(hot, F.lit(False)))
    some = F.broadcast(side.where("__hot").drop("__hot"))
    other = side.where("NOT __hot").drop("__hot")
    cold = rows.join(F.broadcast(side.where("__hot").select(*keys)), keys, "left_anti")
    return rows.join(some, keys).unionByName(cold.join(other, keys, how))
