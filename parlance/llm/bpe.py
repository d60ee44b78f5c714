"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte spans. Positions wait in buckets, one per merge rank; a three-level bitmap over the
ranks gives the lowest waiting rank by find-first-set. A bucket is taken whole; entries whose pair has changed meanwhile are
stale and skipped. A merge costs a constant number of queue steps, so a pre-token of n bytes costs O(n) steps and not O(n^2),
which matters for very long ones; short ones share one queue, which makes the buckets long enough for NumPy.

Texts are cut into pieces before " x" and "\\nx" where both neighbours aren't white space: there the pattern always starts a
new match, so a piece's ids don't depend on its neighbours and may be kept in a bounded cache.

Defined results: null counts as empty, which has no ids; special tokens don't exist, their strings are ordinary text; ids may
be null or repeat, each row is worked on by itself; an empty table gives no rows; other columns pass through `encode` unless
they have the name of a result (in any case of letters) or `__in`: the result replaces the former, the latter is left out.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import release

#: Fixed value: the pattern for which `cut` is right. With any other, texts aren't cut up.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps in each of two generations; about 15 MB each.
KEPT = 80_000
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
TWO_SPACES = re.compile(r"\s\s")
#: Characters of texts that are cut up at once; bounds the memory of a worker.
AT_ONCE = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by rank, lowest rank first: a bucket a rank, and a bitmap of three levels over the ranks."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low, self.mid, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        buckets = self.buckets
        if len(ranks) > 300:  # one step a rank instead of one a position
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order].tolist()
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, a, b in zip(ranks[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(positions)]):
                if rank in buckets:
                    buckets[rank] += positions[a:b]
                else:
                    buckets[rank] = positions[a:b]
                    self.mark(rank)
            return
        for rank, position in zip(ranks.tolist(), positions.tolist()):
            if rank in buckets:
                buckets[rank].append(position)
            else:
                buckets[rank] = [position]
                self.mark(rank)

    def mark(self, rank: int) -> None:
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def pop(self) -> tuple[int, list[int]]:
        v = (self.top & -self.top).bit_length() - 1
        bits = self.mid[v]
        w = v << 6 | ((bits & -bits).bit_length() - 1)
        bits = self.low[w]
        rank = w << 6 | ((bits & -bits).bit_length() - 1)
        self.low[w] = bits = bits & (bits - 1)
        if not bits:
            self.mid[v] &= self.mid[v] - 1
            if not self.mid[v]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Pairs:
    """Rank of the concatenation of two tokens, for arrays of pairs: open addressing over every split of every token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found, values = array("q"), array("i")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found.append(a << 32 | b)
                    values.append(rank)
        keys, values = np.array(found, np.int64), np.array(values, np.int32)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self.home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            took = left[free]
            self.keys[at[took]] = keys[took]  # of several keys for one place the last stays; the others go on
            mine = left[self.keys[at[left]] == keys[left]]
            self.values[at[mine]] = values[mine]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the concatenation is no token."""
        keys = a.astype(np.int64) << 32 | b
        at = self.home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out


class Kept:
    """Ids of pieces seen lately: what isn't asked for while a generation fills up is forgotten with the next."""

    def __init__(self, most: int = KEPT) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def add(self, new: dict[str, bytes]) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update(new if max(map(len, new), default=0) <= 64 else {p: x for p, x in new.items() if len(p) <= 64})


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find, self.cuts = ranks, regex.compile(pattern).findall, pattern == PATTERN
        self.pairs, self.top = Pairs(ranks), max(ranks.values(), default=0)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.kept = Kept()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, all of them worked through by one queue; ids as little-endian unsigned 32-bit integers.

        The pre-tokens lie in one array of bytes as linked lists that don't touch, so the order between them doesn't matter
        and the positions of one bucket are merged at once.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        pair = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.pairs.get(token[inner], token[inner + 1])
        gone, stamp, again = np.zeros(n, bool), np.full(n, -1, np.int32), []
        queue = RankQueue(self.top)
        start = np.flatnonzero(pair >= 0)
        queue.push(pair[start], start)
        turn = 0
        while queue.top:
            rank, waiting = queue.pop()
            i = np.array(waiting)
            i = i[pair[i] == rank]  # the others are stale
            if not len(i):
                continue
            if (pair[after[i]] == rank).any():  # pairs of one rank overlap: the left one of two goes first
                i.sort()
                seen, chosen = -1, []
                for p, q in zip(i.tolist(), after[i].tolist()):
                    if p != seen:
                        chosen.append(p)
                        seen = q
                i = np.array(chosen)
            turn += 1
            j = after[i]
            end = after[j]
            token[i], after[i], stamp[i], gone[j], pair[j] = rank, end, turn, True, -1
            pair[i] = -1
            more = end >= 0
            right, end = i[more], end[more]
            before[end] = right
            pair[right] = new = self.pairs.get(token[right], token[end])
            up = new >= 0
            first = (new[up], right[up])
            queue.push(*first)
            left = before[i]
            open_ = left >= 0
            left, i = left[open_], i[open_]
            alone = stamp[left] != turn  # else it is the right-hand pair of another merge of this turn
            left, i = left[alone], i[alone]
            pair[left] = new = self.pairs.get(token[left], token[i])
            up = new >= 0
            second = (new[up], left[up])
            queue.push(*second)
            # Only ranks that weren't learnt in order give a lower rank here; such pre-tokens are done again one merge a time.
            for r, at in (first, second):
                if len(r) and r.min() < rank:
                    again += at[r < rank].tolist()
        ids = token[~gone].astype("<u4").tobytes()
        counts = np.add.reduceat(~gone, ends - sizes, dtype=np.int64) if n else sizes
        cuts = (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(ends, np.array(again, np.int64), "right")).tolist():
            out[k] = self.merge_one(words[k])
        return out

    def merge_one(self, word: bytes) -> bytes:
        """The same for one pre-token, one merge a time, for ranks in any order."""
        n, get, queue = len(word), self.ranks.get, RankQueue(self.top)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(word[k : k + 2]) for k in range(n - 1)] + [None]
        for k, rank in enumerate(pair):
            if rank is not None:
                queue.push(np.array([rank]), np.array([k]))
        while queue.top:
            rank, waiting = queue.pop()
            waiting.sort()
            for k, i in enumerate(waiting):
                if pair[i] != rank:
                    continue
                j = after[i]
                end = after[i] = after[j]
                before[end], pair[j], pair[i] = i, None, None
                pushed = []
                if end < n:
                    pair[i] = get(word[i : after[end]])
                    pushed.append(i)
                if before[i] >= 0:
                    pair[before[i]] = get(word[before[i] : end])
                    pushed.append(before[i])
                pushed = [x for x in pushed if pair[x] is not None]
                queue.push(np.array([pair[x] for x in pushed]), np.array(pushed))
                if any(pair[x] < rank for x in pushed):
                    left = np.array(waiting[k + 1 :], np.int64)
                    queue.push(np.full(len(left), rank), left)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return np.array(ids, "<u4").tobytes()

    def new_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't kept: each match of the pattern by itself."""
        ranks, known, open_, matches = self.ranks, {}, {}, []
        for piece in pieces:
            found = (common(piece) if self.cuts else None) or self.find(piece)
            matches.append(found)
            for word in found:
                if word not in known and word not in open_:
                    raw = word.encode()
                    rank = ranks.get(raw)
                    if rank is None:
                        open_[word] = raw
                    else:
                        known[word] = rank.to_bytes(4, "little")
        known.update(zip(open_, self.merge(list(open_.values()))))
        return {piece: known[found[0]] if len(found) == 1 else b"".join([known[w] for w in found]) for piece, found in zip(pieces, matches)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return encode_pieces(texts, self.kept, self.new_pieces, self.cuts)


def common(piece: str) -> tuple[str, ...] | None:
    """How the pattern cuts letters, or letters and one mark, behind a space or a line end; None for any other piece."""
    body, first = piece[1:], piece[0]
    if first not in " \n" or not body:
        return None
    if body.isalpha():
        return (piece,) if first == " " else (first, body)
    if body[-1] in ",." and body[:-1].isalpha():
        return (piece[:-1], body[-1]) if first == " " else (first, body[:-1], body[-1])
    return None


def cut(text: str) -> list[str]:
    """Pieces of a text; a piece that doesn't begin with a line end stands for itself behind one space, but for the first."""
    if TWO_SPACES.search(text) or text[0].isspace() or text[-1].isspace():
        found = CUT.split(text)
        return [found[0], *(p if p[0] == "\n" else p[1:] for p in found[1:])]
    return text.replace("\n", " \n").split(" ")


@dataclass
class Cut:
    """Texts cut into pieces: each piece's place in `words`, the pieces of each text, and the texts in the order of the pieces."""

    words: pa.Array
    code: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray
    heads: np.ndarray
    order: list[int]
    odd: list[int]


def in_slices(texts: list[str | None], at_once: int, without: set[int] = frozenset()) -> Iterator[list[int]]:
    """Numbers of texts that aren't empty, in slices of about `at_once` characters."""
    rows, size = [], 0
    for k, text in enumerate(texts):
        if text and k not in without:
            rows.append(k)
            size += len(text)
            if size >= at_once:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def cut_up(texts: list[str], rows: list[int]) -> Cut:
    """Cut texts that aren't empty. Arrow finds the distinct pieces, so a piece costs Python work once and not once an occurrence."""
    odd = [k for k in rows if TWO_SPACES.search(texts[k]) or texts[k][0].isspace() or texts[k][-1].isspace()]
    seen = set(odd)
    plain = [k for k in rows if k not in seen]
    lists = pc.split_pattern(pc.replace_substring(pa.array([texts[k] for k in plain], pa.large_string()), "\n", " \n"), " ")
    cuts = [cut(texts[k]) for k in odd]
    flat = pa.chunked_array([lists.flatten().cast(pa.large_string()), pa.array([p for found in cuts for p in found], pa.large_string())])
    sizes = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.fromiter(map(len, cuts), np.int64, len(cuts))]).astype(np.int64)
    coded = flat.combine_chunks().dictionary_encode()
    code, ends = coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes)
    return Cut(coded.dictionary, code, sizes, ends, code[ends - sizes], [*plain, *odd], odd)


def spell(cut_: Cut, code: np.ndarray, tokens: np.ndarray, lens: np.ndarray, out: list[bytes]) -> None:
    """The ids of each text from those of its pieces: `tokens` one behind the other, `lens` of each, `code` which are wanted."""
    starts, long = np.cumsum(lens) - lens, lens[code]
    stops = np.cumsum(long)
    raw = tokens[np.repeat(starts[code] - (stops - long), long) + np.arange(stops[-1])].tobytes()
    bounds = (4 * np.append(0, stops[cut_.ends - 1])).tolist()
    for k, a, b in zip(cut_.order, bounds, bounds[1:]):
        out[k] = raw[a:b]


def encode_slice(texts: list[str], rows: list[int], out: list[bytes], kept: Kept, new_pieces) -> None:
    """Ids of each text from those of its pieces. `new_pieces` gives the ids of pieces that `kept` doesn't have."""
    cut_ = cut_up(texts, rows)
    words, heads, n = cut_.words.to_pylist(), cut_.heads, len(cut_.words)
    # Pieces stand for themselves behind a space, but for the first of a text, which is a word of its own here.
    inner = np.bincount(cut_.code, minlength=n) > np.bincount(heads, minlength=n)
    young, old = kept.young.get, kept.old.get
    ids = [(young(w) or old(w)) if used else b"" for w, used in zip(words, inner.tolist())]
    missing = [n for n, x in enumerate(ids) if x is None]
    whole = [w if w[0] == "\n" else f" {w}" for w in (words[n] for n in missing)]
    first, at_first = np.unique(heads, return_inverse=True)
    firsts = [words[n] for n in first.tolist()]
    fresh = new_pieces(list({*whole, *firsts}))
    for n, w in zip(missing, whole):
        ids[n] = fresh[w]
    kept.add({words[n]: ids[n] for n in missing})
    code = cut_.code
    code[cut_.ends - cut_.sizes] = len(words) + at_first
    ids += [fresh[w] for w in firsts]
    spell(cut_, code, np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out)


def encode_pieces(texts: list[str | None], kept: Kept, new_pieces, cuts: bool = True, at_once: int = AT_ONCE) -> list[bytes]:
    """Ids of each text; texts that may not be cut up are one piece."""
    out: list[bytes] = [b""] * len(texts)
    collect = gc.isenabled()
    gc.disable()  # long lists without cycles: looking through them again and again finds nothing
    for rows in in_slices(texts, at_once):
        if cuts:
            encode_slice(texts, rows, out, kept, new_pieces)
        else:
            found = new_pieces(list({texts[k] for k in rows}))
            for k in rows:
                out[k] = found[texts[k]]
    if collect:
        gc.enable()
    return out


_encoders: dict[tuple[str, str], Encoder] = {}
_tokens: dict[str, dict[int, bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; its caches last from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 * AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of a column have about `most` bytes together, or are one row."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def per_row(df: DataFrame, column: str, result: str, work, carry: list[str] | None = None) -> DataFrame:
    """`df` with `work(values) -> arrays` of the named result columns added batch by batch; same-named columns are replaced.

    `carry` names the columns that go through the worker and come back (all by default): what is left out there isn't sent twice."""
    added = [x.split()[0] for x in result.split(", ")]
    passed = [c for c in (df.columns if carry is None else carry) if c.lower() not in {a.lower() for a in added} and c != "__in"]
    source = column if column in passed else "__in"
    rows = df.select(*[F.col(f"`{c}`") for c in passed], *([] if column in passed else [F.col(f"`{column}`").alias("__in")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, source):
                arrays = work(batch.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *arrays], names=[*passed, *added])
                del arrays
                release()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__in")
    return rows.mapInArrow(run, f"{schema}, {result}" if schema else result)


def decoded(ids: list[bytes | None], path: str) -> pa.Array:
    """The bytes that little-endian unsigned 32-bit ids stand for; null stands for none."""
    if path not in _tokens:
        _tokens[path] = {rank: token for token, rank in read_ranks(path).items()}
    token = _tokens[path].__getitem__
    try:
        return pa.array([b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids], pa.binary())
    except KeyError as e:
        raise ValueError(f"id {e} isn't in the vocabulary") from None


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", round_trip: bool = False, carry: list[str] | None = None) -> DataFrame:
    """The rows with n_tokens and ids (binary: little-endian unsigned 32-bit integers); with `round_trip` also the bytes that
    these ids decode to (column decoded), in the same pass, which spares a second Python worker a task."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        ids = encoder(path, pattern).encode(texts)
        out = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return [*out, decoded(ids, path)] if round_trip else out

    return per_row(docs, text_col, "n_tokens bigint, ids binary" + ", decoded binary" * round_trip, work, carry)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the bytes that the ids stand for (column decoded); an id that the vocabulary doesn't have is an error."""
    return per_row(rows, ids_col, "decoded binary", lambda ids: [decoded(ids, path)])
