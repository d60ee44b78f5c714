"""Embedding many documents so that what is done stays done: batches, a ledger of finished ones, progress, cancelling.

Documents are dealt to batches by a hash of their id. Each wave embeds some batches on the cluster, writes them to a folder of its own and
enters it in the ledger (the commit log); a run that broke off is taken up where the ledger ends, and rows of a wave that isn't entered are
never read. Which documents there are and how many batches is fixed by the first run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import commits

Embed = Callable[[list[str]], list[list[float]]]


class Cancelled(RuntimeError):
    """The caller wanted it to stop; what is done is kept."""


def vectors(embed: Embed, texts: list[str]) -> list[list[float]]:
    """The vectors of a batch; if memory runs out, of its halves, once."""
    try:
        return list(embed(texts))
    except MemoryError:
        if len(texts) < 2:
            raise
        half = len(texts) // 2
        return [*embed(texts[:half]), *embed(texts[half:])]


def progress(done: int, total: int, waves: int) -> float:
    """Per cent of an index's making: 40 to 85 while documents are embedded; without a known total two a wave, up to 84."""
    return 40 + done / total * 45 if total else float(min(84, 40 + waves * 2))


def finished(spark: SparkSession, root: str) -> set[int]:
    return {b for c in commits.log(spark, root) for b in c.facts["batches"]}


def embed_documents(docs: DataFrame, embed: Embed, root: str, batch_size: int = 32, batches_a_wave: int = 64, report: Callable[[float, int], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """(id, text, embedding) of documents (id, text, unique ids). A second call with the same folder embeds only what no finished wave has."""
    spark, root = docs.sparkSession, root.rstrip("/")
    files = commits.Files(spark, root)
    if not files.fs.exists(files.path("docs/_SUCCESS")):
        files.remove("docs")
        count = docs.count()
        n = max(1, -(-count // batch_size))
        rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        rows.withColumn("wave", F.floor(F.col("batch") / batches_a_wave).cast("int")).repartition("wave", "batch").write.partitionBy("wave").parquet(f"{root}/docs")
    kind = docs.schema["id"].dataType.simpleString()
    kept = spark.read.schema(f"id {kind}, text string, batch int, wave int").parquet(f"{root}/docs")
    sizes = {(r.wave, r.batch): r["count"] for r in kept.groupBy("wave", "batch").count().collect()}
    total, waves = sum(sizes.values()), sorted({w for w, _ in sizes})
    done = finished(spark, root)
    if report:
        report(progress(sum(n for (_, b), n in sizes.items() if b in done), total, 0), len(done))
    for nth, wave in enumerate(waves, 1):
        open_ = sorted(b for w, b in sizes if w == wave and b not in done)
        if not open_:
            continue
        if cancelled():
            raise Cancelled(f"{len(done)} batches are done")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, part in pdf.groupby("batch", sort=True):
                    for k in range(0, len(part), batch_size):
                        some = part.iloc[k : k + batch_size]
                        yield pd.DataFrame({"id": some["id"], "text": some["text"], "embedding": vectors(embed, some["text"].tolist())})

        folder = f"data/{uuid.uuid4().hex}"
        rows = kept.where((F.col("wave") == wave) & F.col("batch").isin(open_))
        rows.mapInPandas(run, f"id {kind}, text string, embedding array<double>").write.parquet(f"{root}/{folder}")
        now = commits.last(spark, root)
        commits.append(spark, root, folder, now.version if now else 0, {"batches": open_})
        done |= set(open_)
        if report:
            report(progress(sum(n for (_, b), n in sizes.items() if b in done), total, nth), len(done))
    folders = [f"{root}/{c.folder}" for c in commits.log(spark, root)]
    return spark.read.parquet(*folders) if folders else kept.select("id", "text", F.array().cast("array<double>").alias("embedding"))
