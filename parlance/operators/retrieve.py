"""Vector recall, level limits, diverse selection, and sources that support an answer."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import strip
from parlance.functions.vector import cosine, distance, relevance_pct
from parlance.operators.nearest import blocks, nearest, ranked


def with_level_fallback(docs: DataFrame, level: str | None) -> DataFrame:
    """Rows of a level, or all rows if it has none."""
    if level is None:
        return docs
    found = docs.agg(F.count_if(F.col("level") == level).alias("found"))
    return docs.join(F.broadcast(found)).where((F.col("level") == level) | (F.col("found") == 0)).drop("found")


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, distance, relevance): the k nearest rows of `docs` (id, embedding) to each of `queries` (query_id, q).

    The queries are a stated set that goes to the data in blocks; each task keeps k rows a query before anything is shuffled
    (`operators/nearest.py`). A vector without length is at distance 1; pairs without a distance come last."""
    rows, asked = docs.select(F.col(id_col).alias("id"), "embedding"), queries.select("query_id", "q")
    if metric == "cosine":
        out = nearest(rows, asked, k)
    else:
        # Rounding makes ties total: equal up to the last bits counts as equal.
        far = F.round(distance(F.col("q"), F.col("embedding"), metric), 9).alias("distance")
        met = [rows.join(F.broadcast(block)).select("query_id", "id", far) for block, _ in blocks(asked, k)]
        out = ranked(reduce(DataFrame.unionByName, met), k)
    return out.select("query_id", "rank", "id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), relevance_pct(F.col("distance")).alias("relevance"))


def level_limits(queries: DataFrame, k: int = 4, chunk_context: int = 6) -> DataFrame:
    """`queries` (…, level, k, segment_count) with recall_n and context_n."""
    kk = F.coalesce("k", F.lit(k))
    wanted = F.coalesce(F.nullif(F.col("segment_count"), F.lit(0)), kk)
    recall = F.when(F.col("level") == "document", 1).when(F.col("level") == "segment", F.greatest(wanted, F.lit(50))).otherwise(F.greatest(kk, F.lit(50)))
    context = F.when(F.col("level") == "document", 1).when(F.col("level") == "segment", wanted).otherwise(F.least(kk, F.lit(chunk_context)))
    return queries.withColumn("recall_n", recall.cast("bigint")).withColumn("context_n", context.cast("bigint"))


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Maximal marginal relevance: near to the query, far from what is chosen; the lowest place wins ties (to nine decimals)."""
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
    near = unit @ (query / (np.linalg.norm(query) + 1e-9))
    left, chosen, closest = np.ones(len(unit), bool), [], np.zeros(len(unit))
    for n in range(min(k, len(unit))):
        score = np.where(left, np.round(weight * near - (1 - weight) * (closest if n else 0), 9), -np.inf)
        best = int(score.argmax())
        chosen.append(best)
        left[best] = False
        closest = np.maximum(closest, unit @ unit[best]) if n else unit @ unit[best]
    return chosen


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(query_id, rank, pos) from (query_id, pos, q, embedding); candidates are the recalled rows, few for each query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        order = mmr_order(np.array(pdf.at[0, "q"], float), np.stack(pdf["embedding"]).astype(float), k, weight)
        return pd.DataFrame({"query_id": pdf.at[0, "query_id"], "rank": range(1, len(order) + 1), "pos": pdf["pos"].to_numpy()[order]})

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "pos")}
    return candidates.select("query_id", "pos", "q", "embedding").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, rank bigint, pos {kinds['pos']}")


def rerank(candidates: DataFrame, k: int, use_mmr: bool = True) -> DataFrame:
    """(query_id, rank, pos) from (query_id, pos, q, embedding): diverse selection where a query has more than k candidates, else the order of similarity."""
    rows = candidates.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    few = rows.where(F.col("n") <= k) if use_mmr else rows
    by = Window.partitionBy("query_id").orderBy(F.round(cosine(F.col("q"), F.col("embedding")), 9).desc(), "pos")
    ranked = few.select("query_id", F.row_number().over(by).cast("bigint").alias("rank"), "pos").where(F.col("rank") <= k)
    return ranked.unionByName(mmr(rows.where(F.col("n") > k), k)) if use_mmr else ranked


def select_sources(candidates: DataFrame, threshold: float = 0.30, most: int = 5, fallback: int = 2) -> DataFrame:
    """Of (query_id, pos, answer, embedding) the rows as near to the answer as `threshold`, or the nearest `fallback` if none is.

    With a column answer_text, a query whose text is blank keeps all its rows in their order, without a percentage."""
    if "answer_text" in candidates.columns:
        blank = F.coalesce(strip(F.col("answer_text")), F.lit("")) == ""
        same = candidates.where(blank).select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("bigint").alias("rank"), "pos", F.lit(None).cast("bigint").alias("answer_relevance_pct"))
        return same.unionByName(select_sources(candidates.where(~blank).drop("answer_text"), threshold, most, fallback))
    rows = candidates.withColumn("sim", F.round(cosine(F.col("answer"), F.col("embedding")), 9))
    by = Window.partitionBy("query_id")
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(F.col("sim").desc(), "pos"))).withColumn("any", F.max(F.col("sim") >= threshold).over(by))
    kept = rows.where(F.when(F.col("any"), (F.col("sim") >= threshold) & (F.col("rank") <= most)).otherwise(F.col("rank") <= fallback))
    pct = F.greatest(F.lit(0), F.bround(F.col("sim") * 100, 0)).cast("bigint")
    return kept.select("query_id", F.col("rank").cast("bigint").alias("rank"), "pos", pct.alias("answer_relevance_pct"))


def context(rows: DataFrame) -> DataFrame:
    """(query_id, context): the chosen rows (query_id, rank, audio_file, speaker, start, end, text) as a model reads them."""
    line = F.format_string("[%s %s %s-%s] %s", "audio_file", "speaker", F.col("start").cast("string"), F.col("end").cast("string"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_id").agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


def source_columns(text: Column) -> list[Column]:
    """A source's text and its preview."""
    return [text.alias("text"), F.substring(text, 1, 200).alias("preview")]


def prompt(question: Column, context_text: Column, starred: Column, reference: Column) -> Column:
    """What a model is asked: starred answers (an array) and reference text, if there are any, before the context and the question."""
    stars = F.when(F.size(F.coalesce(starred, F.array())) > 0, F.concat(F.lit("[STARRED ANSWERS]\n"), F.array_join(starred, "\n---\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    refers = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("[REFERENCE CONTEXT]\n"), reference, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(stars, refers, F.coalesce(context_text, F.lit("")), F.lit("\n\n[QUESTION]\n"), question)


def answer_to_match(answer: Column, stopped: Column, most: int = 1000) -> Column:
    """The text that sources are matched with: of a stopped answer only its beginning."""
    return strip(F.when(stopped, F.substring(answer, 1, most)).otherwise(answer))
