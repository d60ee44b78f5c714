"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of frames: length (8 bytes), masked CRC-32 of the length's bytes (4), payload, masked CRC-32 of the payload
(4). A payload is: flags (1 byte; 1: the id is null), id (8, signed), bytes an id (1), ids. All numbers are little-endian. The
mask turns a checksum right by 15 bits and adds a constant, so that checksums of data that hold checksums stay strong. An index
file beside it has the offset and length of each frame (8 bytes each). Token ids take two bytes where the vocabulary allows it.

Files go to the shared folder through pyarrow's filesystems, so the folder may be on any store that Spark's URI names. Rows are
dealt to files by ranges of the id. Each attempt of a task writes files of its own name; only the files that the kept manifest
names are ever read, so retries and lost executors leave no wrong data.

Defined results: a null or empty text is a record with the end id only; null ids come first; rows that repeat an id are separate
records, ordered by their text's bytes; an empty table gives an empty manifest; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.bpe import cut_up, in_slices, slices, spell
from parlance.llm.shared import shared_dir, stored

#: Fixed value: what masking adds.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<BqB")
#: Bytes that a reader has in memory, besides the frame that it is in.
CHUNK = 4 << 20
#: Characters that a worker encodes at once.
AT_ONCE = 12_000_000
MANIFEST = "part int, path string, records bigint, tokens bigint, bytes bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame."""
    length, check = HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != length + 16:
        raise ValueError("broken length of a record")
    payload = data[12:-4]
    if masked(payload) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("broken record")
    return payload


def pack(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return BODY.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, bytes]:
    """The id and the token ids as little-endian unsigned 32-bit integers."""
    null, doc_id, width = BODY.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=BODY.size).astype("<u4").tobytes()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def write_records(docs: DataFrame, encode: Callable[[list[str | None]], list[bytes]], width: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the encoded texts in ascending id order; the manifest, one row per file. `encode` runs on the executors."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        end, records, tokens, size = np.array([end_id], "<u4"), 0, 0, 0
        with store.open_output_stream(f"{path}.rec") as out, store.open_output_stream(f"{path}.idx") as index:
            for batch in (part for whole in batches for part in slices(whole, "text", 2 * AT_ONCE)):
                ids = batch.column("id").to_pylist()
                for doc_id, raw in zip(ids, encode(batch.column("text").to_pylist())):
                    data = frame(pack(doc_id, np.append(np.frombuffer(raw, "<u4"), end), width))
                    out.write(data)
                    index.write(struct.pack("<QQ", size, len(data)))
                    records, tokens, size = records + 1, tokens + len(raw) // 4 + 1, size + len(data)
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, path, records, tokens, size), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "path", "records", "tokens", "bytes"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    found = stored(rows.mapInArrow(run, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return found.withColumn("tokens_before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def frames(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The frames of a data file in order, read in chunks."""
    with store.open_input_file(f"{path}.rec") as f:
        have, at = b"", 0
        while True:
            need = 12 if len(have) - at < 12 else 16 + HEAD.unpack_from(have, at)[0]
            if len(have) - at < need or need == 12:
                more = f.read(max(CHUNK, need - (len(have) - at)))
                if not more:
                    if at < len(have):
                        raise ValueError(f"{path} is cut short")
                    return
                have, at = have[at:] + more, 0
                continue
            yield have[at : at + need]
            at += need


def read_records(manifest: DataFrame) -> DataFrame:
    """Rows (id, start, n_tokens, ids): start counts the tokens of all records before, ids is as in `bpe.encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, folder, start in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "tokens_before"))):
                store, _ = open_store(folder)
                rows, held = [], 0
                for data in frames(store, path):
                    doc_id, ids = unpack(unframe(data))
                    rows.append((doc_id, start, len(ids) // 4, ids))
                    start, held = start + len(ids) // 4, held + len(ids)
                    if held >= 2 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = manifest.select("path", "folder", "tokens_before")
    # One file a task, as far as there are tasks.
    return files.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")


def read_at(path: str, folder: str, number: int) -> tuple[int | None, bytes]:
    """One record by its number in a file, through the index: what a shuffled reader does."""
    store, _ = open_store(folder)
    with store.open_input_file(f"{path}.idx") as f:
        f.seek(16 * number)
        offset, length = struct.unpack("<QQ", f.read(16))
    with store.open_input_file(f"{path}.rec") as f:
        f.seek(offset)
        return unpack(unframe(f.read(length)))


_tokenizers: dict = {}
#: Pieces that a token beginning with a space or line end starts, and no other token of theirs does.
REGULAR = re.compile(r"\n?\S+")


def library_encoder(path: str, at_once: int = AT_ONCE) -> Callable[[list[str | None]], list[bytes]]:
    """Encode with the tokenizers library, adding no special tokens (those that a text holds are their ids).

    The library is asked once for each distinct piece of a slice of texts. Pieces are sent as running text, in which a token
    that begins with a space or a line end begins a piece; pieces with other white space inside are sent by themselves.
    """

    def load() -> tuple:
        if path not in _tokenizers:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            begins = np.zeros(made.get_vocab_size() + 1, bool)
            begins[[n for token, n in made.get_vocab().items() if token[0] in "\u0120\u010a"]] = True  # how the file writes a space and a line end
            _tokenizers[path] = made, begins, [x.content for x in made.get_added_tokens_decoder().values()]
        return _tokenizers[path]

    def ids_of(asked: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in load()[0].encode_batch_fast(asked, add_special_tokens=False)]

    def running(pieces: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of regular pieces one behind the other, and how many each has."""
        begins, n = load()[1], len(pieces)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lines = pa.LargeListArray.from_arrays(pa.array([*range(0, n, 1000), n], pa.int64()), pieces).cast(pa.large_list(pa.string()))
        ids = np.concatenate(ids_of([between + x for x in pc.binary_join(lines, between).to_pylist()]))
        starts = np.flatnonzero(begins[ids])
        if len(starts) != n:
            raise ValueError("the vocabulary splits pieces otherwise than expected")
        return ids, np.diff(np.append(starts, len(ids)))

    def encode_some(texts: list[str], rows: list[int], out: list[bytes]) -> None:
        cut_ = cut_up(texts, rows)
        words, heads = cut_.words, cut_.heads
        regular = np.ones(len(words), bool)
        if cut_.odd:  # only these texts have pieces with white space inside
            regular = np.array([bool(REGULAR.fullmatch(w)) for w in words.to_pylist()], bool)
        line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False) & regular
        parts, sizes, place = [], [], np.zeros(len(words), np.int64)
        done = 0
        for mask, between in ((regular & ~line, " "), (line, "")):
            at = np.flatnonzero(mask)
            ids, n = running(words.take(pa.array(at)), between)
            place[at] = np.arange(done, done + len(at))
            parts.append(ids)
            sizes.append(n)
            done += len(at)
        at = np.flatnonzero(~regular)
        alone = ids_of([w if w[0] == "\n" else f" {w}" for w in words.take(pa.array(at)).to_pylist()])
        place[at] = np.arange(done, done + len(at))
        done += len(at)
        # A text's first piece has no space in front. Behind a line end it has the same ids, and the line end is one token more.
        first, at_first = np.unique(heads, return_inverse=True)
        found = words.take(pa.array(first)).to_pylist()
        fine = [bool(REGULAR.fullmatch(w)) and w[0] != "\n" for w in found]
        asked = ids_of([f"\n{w}" if ok else w for w, ok in zip(found, fine)])
        parts += [*alone, *(x[1:] if ok else x for x, ok in zip(asked, fine))]
        sizes.append(np.fromiter((len(x) for x in parts[2:]), np.int64, len(parts) - 2))
        code = place[cut_.code]
        code[cut_.ends - cut_.sizes] = done + at_first
        spell(cut_, code, np.concatenate(parts), np.concatenate(sizes), out)

    def encode(texts: list[str | None]) -> list[bytes]:
        added = load()[2]
        out = [b""] * len(texts)
        # White space before an added token is cut otherwise than before a word: such texts go to the library whole.
        whole = {k for k, text in enumerate(texts) if text and any(x in text for x in added)}
        for k in whole:
            out[k] = ids_of([texts[k]])[0].tobytes()
        for rows in in_slices(texts, at_once, whole):
            encode_some(texts, rows, out)
        return out

    return encode
