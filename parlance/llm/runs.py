"""Periodic runs of words: the Kolpakov-Kucherov algorithm on the words of each text.

A run is a stretch of words with smallest period q that no neighbouring word extends; `least` and `times` say which ones count
(length >= max(least, times * q)). Each repeated stretch of a text is factorised by a suffix automaton (each factor is the longest
prefix of the rest that also starts earlier), Main's algorithm finds the runs that cross or touch a factor's border, and the
runs strictly inside a factor are copied from its earlier occurrence.

Before that, words that can't be in a run are set aside: every stretch of k words in a run occurs at least twice in it, k as in
`gram`, so the automaton is only built over stretches whose k-grams repeat. This is exact (equal words have equal hashes; a clash
of hashes only keeps more words), and running text costs little more than its splitting.

Texts are worked through one at a time in Arrow slices, without a shuffle, so no key is hot; a text needs about 600 bytes of memory for each
word of its longest repeated stretch. Defined results: a null or empty text has no words and no runs; rows that repeat an id or a text
are separate rows; an empty table gives no rows; other columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.bpe import per_row

Run = tuple[int, int, int]  # start, end, period
RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton(letters: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton, and for each state where its words first end."""
    to: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for at, c in enumerate(letters):
        new = len(to)
        to.append({})
        link.append(0)
        size.append(at + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[p] + 1 < size[q]:  # only the shorter words of q go on as the new state's suffixes do
                twin = len(to)
                to.append(to[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
        last = new
    return to, first


def factorise(letters: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, end, distance back to an earlier occurrence; 0 for a letter that is new). Occurrences may overlap."""
    to, first = automaton(letters)
    out, start, n = [], 0, len(letters)
    while start < n:
        state, end = 0, start
        while end < n and first[after := to[state][letters[end]]] < end:
            state, end = after, end + 1
        out.append((start, end, end - 1 - first[state]) if end > start else (start, start + 1, 0))
        start = out[-1][1]
    return out


def prefixes(seq: list[int]) -> list[int]:
    """For each place of `seq`, how far what follows agrees with its beginning."""
    n = len(seq)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and seq[k] == seq[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


class Runs:
    """Runs found so far, by start."""

    def __init__(self, letters: list[int], least: int, times: int) -> None:
        self.letters, self.least, self.times = letters, least, times
        self.periods: dict[tuple[int, int], int] = {}
        self.starts: list[int] = []
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if (start, end) in self.periods:
            self.periods[start, end] = min(period, self.periods[start, end])
            return
        self.periods[start, end] = period
        if start not in self.ends:
            insort(self.starts, start)
        self.ends.setdefault(start, []).append(end)

    def offer(self, start: int, end: int, period: int) -> None:
        """Add a repetition if it is long enough and can't be extended."""
        w = self.letters
        if end - start >= max(self.least, self.times * period) and (start == 0 or w[start - 1] != w[start - 1 + period]) and (end == len(w) or w[end] != w[end - period]):
            self.add(start, end, period)

    def cross(self, border: int, before: int, after: int) -> None:
        """Main's algorithm at the border between factors of these lengths: all runs that end in the second or at the border, and begin no later than it.

        Such a run begins less than 2 * before + after ahead of the border and its period is at most before + after, as otherwise the first factor could have been longer."""
        if 2 * (before + after) < self.least:
            return
        w = self.letters
        t, u = w[max(0, border - 2 * before - after) : border], w[border : border + after]
        most = min(before + after, (len(t) + after) // self.times)
        near = t[max(0, len(t) - most) :]
        ahead = prefixes([*u, -1, *near, *u])
        back = prefixes([*t[::-1], -1, *u[::-1], *t[::-1]])
        for p in range(1, min(most, len(t)) + 1):  # at least one period lies before the border
            same, more = back[p] if p < len(t) else 0, ahead[after + 1 + len(near) - p]
            if same + more >= p:
                self.offer(border - p - same, border + more, p)
        for p in range(1, min(most, after) + 1):  # at least one period lies behind the border
            same, more = back[len(t) + 1 + after - p], ahead[p] if p < after else 0
            if same + more >= p:
                self.offer(border - same, border + p + more, p)

    def copy(self, start: int, end: int, distance: int) -> None:
        """Runs strictly inside a factor, from its earlier occurrence; where the two overlap, from copies just made."""
        at = bisect_right(self.starts, start - distance)
        while at < len(self.starts) and self.starts[at] < end - distance:
            s = self.starts[at]
            for e in list(self.ends[s]):
                if e < end - distance:
                    self.add(s + distance, e + distance, self.periods[s, e])
            at += 1


def runs_of(letters: list[int], least: int, times: int = 2) -> list[Run]:
    """All runs of at least `least` letters and `times` (2 or more) periods, by start, then period."""
    found, before = Runs(letters, least, times), 0
    for start, end, distance in factorise(letters):
        if start:
            found.cross(start, before, end - start)
        if distance:
            found.copy(start, end, distance)
        before = end - start
    found.cross(len(letters), before, 0)
    return sorted(((s, e, p) for (s, e), p in found.periods.items()), key=lambda r: (r[0], r[2]))


def gram(least: int, times: int) -> int:
    """The largest k for which every k letters in a row of a run occur twice in it: its length is at least 2 q + k - 1 for every period q that it may have."""
    return 1 + min(least - 2 * (least // times), (times - 2) * -(-least // times))


def repeated(hashes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (start, end) that hold all runs: their k-grams repeat inside them."""
    k, done, open_ = gram(least, times), [], [(0, len(hashes))]
    while open_:
        start, end = open_.pop()
        if end - start < least:
            continue
        h, m = hashes[start:end], end - start - k + 1
        g = np.zeros(m, np.uint64)
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        twice = np.zeros(m + 2, np.int8)
        twice[1 + order[1:][same]] = twice[1 + order[:-1][same]] = 1
        edges = np.flatnonzero(np.diff(twice))
        parts = [(start + a, start + b + k - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least - k + 1]
        (done if parts == [(start, end)] else open_).extend(parts)
    return sorted(done)


def text_runs(words: list[bytes], least: int, times: int) -> list[Run]:
    """The runs of a text's words."""
    if len(words) < least:
        return []
    out: list[Run] = []
    for start, end in repeated(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least, times):
        codes: dict[bytes, int] = {}
        letters = [codes.setdefault(w, len(codes)) for w in words[start:end]]
        out += [(start + s, start + e, p) for s, e, p in runs_of(letters, least, times)]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that repeat what came before in a run: all but its first period go."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, end, period in runs:
        gone[start + period] += 1
        gone[end] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The rows with their columns `carry` (all by default) and: runs (array of start, length, period, by start, then period), strongest (the run
    with the greatest length / period, the first of equals, null without a run) and collapsed (the text's words without those that
    runs repeat, joined by one space). Words are what lies between the characters \\x20 and \\x09-\\x0D."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def work(texts: list[str | None]) -> list[pa.Array]:
        all_runs, best, kept = [], [], []
        for text in texts:
            words = (text or "").encode().split()
            runs = text_runs(words, least, times)
            rows = [(s, e - s, p) for s, e, p in runs]
            all_runs.append([dict(zip(("start", "length", "period"), r)) for r in rows])
            best.append(dict(zip(("start", "length", "period"), min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))) if rows else None)
            kept.append(b" ".join(collapse(words, runs) if runs else words).decode())
        return [pa.array(all_runs, pa.list_(RUN_TYPE)), pa.array(best, RUN_TYPE), pa.array(kept, pa.string())]

    return per_row(docs, text_col, f"runs array<{RUN}>, strongest {RUN}, collapsed string", work, carry)
