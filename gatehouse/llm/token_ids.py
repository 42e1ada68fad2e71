"""Token ids in a binary format with random access: directly addressable codes.

The ids of a segment are split into chunks of bits, one level after the other.  Level 0 holds the lowest chunk of every id; a bitmap
of the level tells which ids go on, and level 1 holds the next chunk of those, and so on.  The place of an id in the next
level is the rank of its bit, read from a directory of counts and one block of the bitmap.  So any id is reached with one look per level;
no block is decoded.

A segment is one binary value (the file format below) in a row of a Parquet table, written by Spark's own committers, so lost
executors leave no halves.  Segments are in ascending order of document key.

    bytes 0-3    "DAC1"
    bytes 4-7    bits of a chunk (8 or 16), u32
    bytes 8-15   number of ids, u64
    bytes 16-19  number of levels, u32;  20-23 zero
    per level    u64 count, chunks (padded to 8 bytes), bitmap (u64 words), directory (u32 ones before each 512 bits, padded to 8 bytes)
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.arrow import map_in_arrow, quoted
from gatehouse.llm.pieces import WordCache, slices
from gatehouse.llm.storage import stored

MAGIC = b"DAC1"
CHUNK_BITS = 8
BLOCK = 512  # bits of a directory block
END_ID = 2
# A segment is closed once it holds this many ids; a longer document has one of its own.
SEGMENT_IDS = 1 << 18
SEGMENT_DOCS = 1 << 14

_SEPARATOR = "<|startoftext|>"
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
# A letter ends a token of the tokenizer's first step where an ASCII sign follows.
_SIGN = "[!-/:-@\\[-`{-~]"
_STOP = re.compile(f"{_SIGN}(?<=[A-Za-zÀ-ÖØ-öø-ÿ]{_SIGN})")


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> bytes:
    """A segment of the format from unsigned 32-bit ids."""
    kind = {8: np.uint8, 16: np.uint16}[chunk_bits]
    rest, levels = ids.astype(np.uint32), []
    while len(rest) or not levels:
        more = (rest >> chunk_bits) > 0
        bitmap = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(np.array([len(rest)], "<u8").tobytes() + _padded((rest & ((1 << chunk_bits) - 1)).astype(kind).tobytes()) + bitmap.tobytes() + _padded(directory.tobytes()))
        rest = rest[more] >> chunk_bits
    head = MAGIC + np.array([chunk_bits], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([len(levels), 0], "<u4").tobytes()
    return head + b"".join(levels)


class Segment:
    """Views into a packed segment; nothing is decoded until it is asked for."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.bits = int(np.frombuffer(raw, "<u4", 1, 4)[0])
        self.size = int(np.frombuffer(raw, "<u8", 1, 8)[0])
        at, self.levels = 24, []
        for _ in range(int(np.frombuffer(raw, "<u4", 1, 16)[0])):
            n = int(np.frombuffer(raw, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(raw, np.uint8 if self.bits == 8 else "<u2", n, at)
            at += -(-n * self.bits // 64) * 8
            bitmap = np.frombuffer(raw, "<u8", -(-n // 64), at)
            at += bitmap.nbytes
            blocks = -(-n // BLOCK) + 1
            directory = np.frombuffer(raw, "<u4", blocks, at)
            at += -(-blocks * 4 // 8) * 8
            self.levels.append((chunks, bitmap, directory))

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at some positions, by rank; the rest of the segment is not touched."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.size):
            raise IndexError("position outside the segment")
        out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(k * self.bits)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            goes_on = (bitmap[word] >> bit) & np.uint64(1) == 1
            open_, at, word, bit = open_[goes_on], at[goes_on], word[goes_on], bit[goes_on]
            if not len(at):
                break
            rank = directory[at // BLOCK].astype(np.int64)
            first = (at // BLOCK) * (BLOCK // 64)
            for step in range(BLOCK // 64):  # whole words of the block before the position
                inside = first + step < word
                rank += np.where(inside, np.bitwise_count(bitmap[np.minimum(first + step, len(bitmap) - 1)]), 0)
            rank += np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = rank
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, open_ = np.zeros(self.size, np.uint32), np.arange(self.size)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[open_] |= chunks.astype(np.uint32) << np.uint32(k * self.bits)
            open_ = open_[np.unpackbits(bitmap.view(np.uint8), count=len(chunks), bitorder="little").astype(bool)]
        return out


class TextEncoder:
    """Ids of whole texts by the ``tokenizers`` library, one call per distinct word.

    The tokenizer's own first step cuts texts at white space and between a letter and an ASCII sign, so words encoded
    apart give the ids of the whole text.  Words of many texts go in one call, with a special token between them.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallel work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(_SEPARATOR)
        self.cache = WordCache(self._encode_words, 1_000_000)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if "<|" not in w] if self.separator is not None else []
        out = {}
        for i in range(0, len(plain), 4096):
            run = plain[i:i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([_SEPARATOR.join(run)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            line = ids.tobytes()
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            out.update((w, line[4 * a:4 * b]) for w, a, b in zip(run, starts, ends))
        rest = [w for w in words if w not in out]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        # Control characters that Python takes for space, and names of special tokens: left as they are.
        if any(c in text for c in _ODD):
            return [w for w in re.split("[ \n\t\r]+", text) if w]
        try:
            text.encode("latin-1")
            text = text.lower()  # as the tokenizer does next; fewer distinct words
        except UnicodeEncodeError:
            pass  # beyond Latin-1 the two might differ in a letter
        return _STOP.sub(r" \g<0>", text).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for run in slices(texts):
            lists = [self._words(t) for t in run]
            known = self.cache.of(set().union(*lists))
            out += [b"".join(map(known.__getitem__, words)) for words in lists]
        return out


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


_SEGMENT_SCHEMA = "part int, seg int, n_ids long, keys array<long>, lengths array<long>, payload binary"


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes whole texts and writes the ids, in ascending order of the key, as segments to the shared folder.

    Returns the table of segments as read back: ``part, seg`` (their order), ``n_ids``, ``keys`` and ``lengths`` of the documents inside
    (the end id counts), and ``payload``, the bytes of the format.  Null texts count as empty and have the end id only.
    Documents with equal keys stay apart, ordered by a hash of their text; null keys come first.  An empty table has no segments.
    """
    rows = docs.select(F.col(quoted(key)).cast("long").alias("key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seg = text_encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        keys, lines, held = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(lines), "<u4")
            values = [[part], [seg], [len(ids)], [keys], [[len(x) // 4 for x in lines]], [pack(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "seg", "n_ids", "keys", "lengths", "payload"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = 0
            for group in slices(texts):
                for name, line in zip(names[done:done + len(group)], coder.encode(group)):
                    line += end
                    if keys and (held + len(line) // 4 > SEGMENT_IDS or len(keys) >= SEGMENT_DOCS):
                        yield close()
                        keys, lines, held, seg = [], [], 0, seg + 1
                    keys.append(name)
                    lines.append(line)
                    held += len(line) // 4
                done += len(group)
        if keys:
            yield close()

    return stored(map_in_arrow(ordered, run, _SEGMENT_SCHEMA), "token-ids")


def with_starts(segments: DataFrame) -> DataFrame:
    """``segments`` with ``start``: the number of ids before each.

    Prefix sums in two steps: over the totals of the parts (one row per range partition, the only ordered window without a key)
    and inside each part.
    """
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # Payloads stay out of the sort; the directory of segments is small.
    place = segments.select("part", "seg", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(before, "part")
    return segments.join(place.select("part", "seg", (F.col("before") + F.col("within")).alias("start")), ["part", "seg"])


def read_documents(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the stored bytes: key, ``start``, ``n_tokens``, ``ids_crc32`` (of its ids as little-endian u32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, lengths, payload in zip(*(batch.column(i) for i in range(4))):
                line = memoryview(Segment(payload.as_py()).all().astype("<u4").tobytes())
                n = lengths.values.to_numpy()
                ends = np.cumsum(n)
                starts = ends - n
                crcs = [zlib.crc32(line[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(starts + start.as_py()), pa.array(n), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    out = map_in_arrow(with_starts(segments).select("start", "keys", "lengths", "payload"), run, "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def lookup(segments: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """``position, id`` for distinct global positions: each is sent to its segment and read there by rank.

    Positions outside the ids are left out.  Segments are found by a range of their directory, which is grouped by
    blocks of positions so that the join is an equality.
    """
    size = SEGMENT_IDS
    directory = with_starts(segments).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_ids") - 1) / size))))
    wanted = positions.select(F.col(quoted(position)).cast("long").alias("p")).where("p is not null").distinct().withColumn("block", F.floor(F.col("p") / size))
    hits = directory.select("part", "seg", "start", "n_ids", "block").join(wanted, "block").where("p >= start and p < start + n_ids")
    asked = hits.groupBy("part", "seg", "start", F.floor(F.col("p") / 4096).alias("run")).agg(F.collect_list("p").alias("ps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ps, payload in zip(*(batch.column(i) for i in range(3))):
                at = ps.values.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(Segment(payload.as_py()).take(at - start.as_py()).astype(np.int64))], names=["position", "id"])

    return map_in_arrow(asked.join(segments.select("part", "seg", "payload"), ["part", "seg"]).select("start", "ps", "payload"), run, "position long, id long")
