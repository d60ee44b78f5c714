"""URL filtering: a blocked Bloom filter of listed entries passes possible hits to an exact hash join.

Entries are canonical: host and path prefix as one string (`example.org/es/`). A URL asks for every suffix of its host at dots with every
prefix of its path whose length some entry has. The filter has blocks of eight 32-bit words and sets one bit in each word, so a look-up
touches one block; it is sized by the list, bounded by `MAX_BYTES` (beyond that more false hits pass), and sent to the tasks. What
passes is joined exactly with the list, which removes false positives at any size of list; the longest entry wins.

Two lists may be given: rules, whose verdict holds whatever else, and blocked entries, which give the method's own verdict where no rule fits.

Defined results: a null url or one without `://` has an empty host and path and no rule, and is allowed; A-Z in hosts are lower-cased, paths stay
as they are; ids may be null or repeat; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from parlance.llm.shared import HOT_KEYS, LOWER, UPPER, skewed_join, stored

BITS_PER_ENTRY = 16
MAX_BYTES = 32 << 20
#: Odd multipliers, one for each word of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    whole = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^?#]*", 0)
    host = F.regexp_extract(whole, r"^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.substring(whole, F.length(host) + 1, F.length(whole))


def place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number, and one bit of each of its words, by the two halves of a 64-bit hash."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    bit = (low[:, None] * SALTS) >> np.uint32(27)
    return block.astype(np.int64), np.uint32(1) << bit


def bloom(entries: DataFrame) -> np.ndarray:
    """The filter of a table of entries (column entry) as an array (blocks, 8); built in parts, joined by OR."""
    n = entries.count()
    blocks = min(MAX_BYTES // 32, max(1, -(-n * BITS_PER_ENTRY // 256)))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, bits = place(batch["h"].to_numpy(np.int64), blocks)
            yield pd.DataFrame({"block": block} | {f"w{k}": bits[:, k].astype(np.int64) for k in range(8)})

    words = entries.select(F.xxhash64("entry").alias("h")).mapInPandas(build, "block bigint, " + ", ".join(f"w{k} bigint" for k in range(8)))
    rows = words.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toPandas()
    out = np.zeros((blocks, 8), np.uint32)
    out[rows["block"].to_numpy(np.int64)] = rows[[f"w{k}" for k in range(8)]].to_numpy(np.int64).astype(np.uint32)
    return out


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict. `listed` has the columns entry, verdict and rule (boolean)."""
    spark = pages.sparkSession
    listed = stored(listed.groupBy("entry").agg(F.max_by("verdict", F.col("rule").cast("int")).alias("verdict"), F.max("rule").alias("is_rule")))
    path_of = F.substring("entry", F.greatest(F.instr("entry", "/"), F.lit(1)), F.length("entry"))
    lengths = [r[0] for r in listed.select(F.length(path_of).alias("n")).distinct().orderBy("n").collect()]  # at most the longest path's length
    sent = spark.sparkContext.broadcast(bloom(listed))

    @F.pandas_udf(BooleanType())
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        table = sent.value
        block, bits = place(hashes.to_numpy(np.int64), len(table))
        return pd.Series(((table[block] & bits) == bits).all(axis=1))

    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    asked = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    urls = stored(rows.where("host <> '' AND path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    total = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = urls.select("host", "path", F.explode(asked).alias("entry")).where(may_be_listed(F.xxhash64("entry")))
    exact = hits.join(listed, "entry")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("entry", "verdict", "is_rule"), F.struct("is_rule", F.length("entry"))).alias("b"))
    best = stored(best.join(urls, ["host", "path"]))
    out = skewed_join(rows, best, ["host", "path"], F.col("n") > total // HOT_KEYS, "left")
    rule = F.when(F.col("b.is_rule"), F.col("b.entry"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
