"""How well a transcript agrees with a reference."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What doesn't count in a comparison (fixed).
MARKS = re.compile(r"[。、！？,.!?]")


def plain(text: str | None) -> str:
    """NFKC, without punctuation."""
    return MARKS.sub("", unicodedata.normalize("NFKC", text or ""))


def places(seq: Sequence) -> dict:
    """For each symbol, a bit for each of its places."""
    found: dict = {}
    for i, x in enumerate(seq):
        found[x] = found.get(x, 0) | 1 << i
    return found


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence, int]:
    """The two without what they begin and end with alike, and how much that is."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return a[head : len(a) - tail], b[head : len(b) - tail], head + tail


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance, a column of the table at once: what grows and what falls from row to row are bits of whole numbers (Myers)."""
    a, b, _ = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    at, full, last = places(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(flat | up))
        right_down = up & flat
        distance += bool(right_up & last) - bool(right_down & last)
        right_up = right_up << 1 | 1
        beside = eq | down
        up = (right_down << 1 | ~(beside | right_up)) & full
        down = right_up & beside & full
    return distance


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a column at once: a bit falls where it grows."""
    a, b, same = trimmed(a, b)
    at, full = places(a), (1 << len(a)) - 1
    rest = full
    for x in b:
        met = rest & at.get(x, 0)
        rest = (rest + met | rest - met) & full
    return same + len(a) - rest.bit_count()


def words(text: str) -> list[str]:
    """The stand-in for a language's own tokenizer: what white space parts."""
    return text.split()


FACTS = "reference_length bigint, hypothesis_length bigint, distance bigint, common bigint, word_distance bigint, n_words bigint, both bigint, n_r bigint, n_h bigint"


def quality(pairs: DataFrame, tokens: Callable[[str], list[str]] = words) -> DataFrame:
    """(id, reference_length, hypothesis_length, distance, cer, ratio, wer, precision, recall, f1) from (id, reference, hypothesis).

    Texts are compared in NFKC, without punctuation and white space; ratio is 1 - insertions and deletions / both lengths. `tokens` parts a
    text without punctuation; WER is the distance of token lists, precision, recall and F1 are of token sets. Against an empty
    reference, CER and WER are the number of characters or words that are there instead."""

    @F.pandas_udf(FACTS)
    def facts(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
        out = []
        for r, h in zip(map(plain, reference), map(plain, hypothesis)):
            a, b, ta, tb = "".join(r.split()), "".join(h.split()), tokens(r), tokens(h)
            out.append((len(a), len(b), edit_distance(a, b), common_length(a, b), edit_distance(ta, tb), len(ta), len({*ta} & {*tb}), len({*ta}), len({*tb})))
        return pd.DataFrame(out, columns=[x.split()[0] for x in FACTS.split(", ")])

    out = pairs.select("id", facts(F.col("reference"), F.col("hypothesis")).alias("f")).select("id", "f.*")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    p, q = share("both", "n_h"), share("both", "n_r")
    rate = {
        "cer": F.col("distance") / F.greatest(F.col("reference_length"), F.lit(1)), "ratio": F.coalesce(2 * F.col("common") / F.nullif(F.col("reference_length") + F.col("hypothesis_length"), F.lit(0)), F.lit(1.0)),
        "wer": F.col("word_distance") / F.greatest(F.col("n_words"), F.lit(1)), "precision": p, "recall": q, "f1": F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0)),
    }
    return out.select("id", "reference_length", "hypothesis_length", "distance", *[F.round(c, 6).alias(n) for n, c in rate.items()])
