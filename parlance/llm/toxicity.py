"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are unigrams of words, of their first four and of their first five letters (crude stems, for languages with many endings),
bigrams and bigrams that skip one word, each present or not, hashed to 2**`bits` places. FTRL-proximal gives each place its own
learning rate and an L1 threshold, so that most weights are exactly zero and the model is a short list of places and weights.

The model is fitted on a bounded sample: the `max_train` labelled rows with the smallest hash of their id. It is dealt to as many
tasks as it has `rows_per_learner` rows; each runs several passes over its part, and their weights are averaged. Only the weights
that aren't zero (2**bits at most) come to the driver and are broadcast. All documents are scored, over their whole text.

Defined results: null and empty texts have the bias as their only feature; a document with several labels counts as toxic if one says
so; a null label is no label; a null id counts as held out; with no labelled row at all every score is 0.5 less the smallest step (0.4999), so nothing is rejected; ids may be
null or repeat, each row is scored by itself; an empty table gives no rows; other columns aren't
read, and pass through `drop_toxic` unless one is called `__score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import release, stored

MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…-*_"
#: Words whose hashes a worker keeps.
KEPT = 120_000
#: Words that are turned into features at once; bounds the memory that a very long text takes.
AT_ONCE = 200_000


@dataclass(frozen=True)
class Ftrl:
    """The rates and penalties are the ones with the fewest errors in cross-validation over the training rows; see the README."""

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    positive: float = 2.0
    passes: int = 6
    max_train: int = 24_000
    rows_per_learner: int = 6_000
    seed: int = 7


class Words(dict):
    """Word to three hashes (word, first four letters, first five), in one table of rows."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 12, 3), np.uint64)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        bare = word.strip(MARKS)
        self.table[n] = [crc32(x.encode()) + 1 for x in (bare, "4" + bare[:4], "5" + bare[:5])]
        self[word] = n
        return n


_words = Words()
#: Odd multipliers that keep the kinds of features apart.
M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def features(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """Places of a text's features, with repeats, in parts of bounded size."""
    global _words
    if len(_words) > KEPT:
        _words = Words()
    found = (text or "").lower().split()
    shift = np.uint64(64 - bits)
    for k in range(0, len(found), AT_ONCE):
        some = found[max(0, k - 2) : k + AT_ONCE]
        at = np.fromiter(map(_words.__getitem__, some), np.int64, len(some))
        table = _words.table[at]
        word = table[:, 0]
        kinds = [table[:, j] * M[j] for j in range(3)]
        kinds.append(word[:-1] * M[3] + word[1:] * M[0])
        kinds.append(word[:-2] * M[4] + word[2:] * M[5])
        h = np.concatenate(kinds)
        yield ((h ^ (h >> np.uint64(29))) * M[1] >> shift).astype(np.int64)


def distinct_features(text: str | None, bits: int) -> np.ndarray:
    parts = list(features(text, bits))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def learn(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> np.ndarray:
    """Weights of 2**bits places and, last, the bias."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(p.seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == size - 1, 0.0, p.l1)
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.passes):
        for k in rng.permutation(len(rows)):
            at = np.append(rows[k], np.int32(size - 1))
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]) * (p.positive if labels[k] else 1.0)
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / p.alpha * w
            n[at] = new
    out, seen = np.zeros(size), np.flatnonzero(n)
    out[seen] = weights(seen)
    return out


def place_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows' places, as views of the column's own memory."""
    found = (x.as_buffer() for chunk in column.chunks for x in chunk)
    return [np.frombuffer(b, np.int32) if b.size else np.zeros(0, np.int32) for b in found]


def fold(doc_id: Column) -> Column:
    """The fifth that a document belongs to; 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't zero; the bias has the place 2**bits."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = stored(known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(params.max_train))
    learners = max(1, -(-sample.count() // params.rows_per_learner))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    bits = params.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [distinct_features(t, bits).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("learner"), pa.array([x.tobytes() for x in places], pa.binary())], names=["id", "y", "learner", "places"])
            del places
            release()

    rows = rows.withColumn("learner", F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(learners)).cast("int")).select("id", "y", "learner", "text")
    kind = rows.schema["id"].dataType.simpleString()
    seen = rows.mapInArrow(extract, f"id {kind}, y int, learner int, places binary")

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("places", "ascending")])
        w = learn(place_rows(table.column("places")), table.column("y").to_numpy().astype(float), params)
        at = np.flatnonzero(w)
        out = pa.table({"place": at, "weight": w[at]})
        del table, w
        release()
        return out

    found = seen.groupBy("learner").applyInArrow(train, "place bigint, weight double").groupBy("place").agg((F.sum("weight") / learners).alias("weight")).orderBy("place").toPandas()
    return found["place"].to_numpy(np.int64), found["weight"].to_numpy(float)


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], name: str, text_col: str = "text", bits: int = Ftrl.bits) -> DataFrame:
    """The rows with the score of their text as the column `name`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places, found = sent.value
        weights = np.zeros((1 << bits) + 1, np.float32)
        weights[places] = found
        bias = float(found[places == 1 << bits].sum()) if len(places) else -4e-4
        used = weights != 0
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch):
                hits = [x[used[x]] for x in features(text.as_py(), bits)]
                out[k] = bias + (float(weights[np.unique(np.concatenate(hits))].sum(dtype=float)) if hits else 0.0)
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))
            batch = text = None  # the text is a view of the batch
            release()

    return docs.withColumn(name, scores(F.col(f"`{text_col}`")))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = Ftrl.bits, threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = with_score(rows, model, "score", "text", bits)
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Ftrl = Ftrl()) -> DataFrame:
    """Fit on the labelled rows outside the held-out fifth, score every row."""
    return score(docs, fit(docs, labels, id_col, text_col, params=params), id_col, text_col, params.bits)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns; each row is judged by its own text, nothing is shuffled."""
    scored = with_score(docs, fit(docs, labels, id_col, text_col, params=params), "__score", text_col, params.bits)
    return scored.where(F.col("__score") < threshold).drop("__score")
