"""SentencePiece encoding and decoding: best segmentation under the piece scores of a vocabulary, by shared-prefix Viterbi.

The distinct marked words are sorted, which is a trie walked depth-first: from one word to the next, the forward scores of the
common prefix stay, only the rest is computed.  Pieces that end at a position are found in a trie of reversed pieces.  Pieces do not go
over the start of a word, so the best segmentation of a text is that of its words.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gatehouse.llm.arrow import map_in_arrow, with_columns
from gatehouse.llm.pieces import Vocabulary, WordCache, char_bytes, load_vocabulary, marked_words, slices


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        # A byte costs more than any two pieces: bytes are taken only where no piece fits.
        self.byte_score = 2 * min(vocabulary.scores, default=0) - 1
        self.ends: dict = {}  # trie of reversed pieces; a node is [nodes below, score or None, id]
        for piece, i in vocabulary.ids.items():
            level, node = self.ends, None
            for c in reversed(piece):
                node = level.setdefault(c, [{}, None, -1])
                level = node[0]
            node[1:] = vocabulary.scores[i], i
        self.cache = WordCache(self.encode_sorted)

    def encode_sorted(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32-bit) of each of the sorted words.  Of equal scores, the shorter last piece counts."""
        out, ends, byte_ids, byte_score = {}, self.ends, self.vocabulary.byte_ids, self.byte_score
        score: list[int] = [0]  # best score of the prefix of each length
        start: list = [0]  # length of the prefix before its last piece
        piece: list = [None]  # the id of that piece, or the ids of bytes
        before = ""
        for word in words:
            common = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                common += 1
            del score[common + 1:], start[common + 1:], piece[common + 1:]
            for i in range(common, len(word)):
                level, j, best, at, last = ends, i, None, i, None
                while j >= 0:
                    node = level.get(word[j])
                    if node is None:
                        break
                    level, value, number = node
                    if value is not None:
                        total = score[j] + value
                        if best is None or total > best:
                            best, at, last = total, j, number
                    j -= 1
                if best is None or best < score[i] + byte_score:
                    raw = char_bytes(word[i])
                    total = score[i] + byte_score * len(raw)
                    if best is None or best < total:
                        best, at, last = total, i, [byte_ids[b] for b in raw]
                score.append(best)
                start.append(at)
                piece.append(last)
            ids, at = [], len(word)
            while at:
                last = piece[at]
                if isinstance(last, list):
                    ids.extend(reversed(last))
                else:
                    ids.append(last)
                at = start[at]
            out[word] = array("I", reversed(ids)).tobytes()
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for run in slices(texts):
            words = [list(marked_words(t)) if t else [] for t in run]
            known = self.cache.of(set().union(*[part for parts in words for part in parts]))
            out += [b"".join([x for part in parts for x in map(known.__getitem__, part)]) for parts in words]
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(load_vocabulary(path))


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a list of ids.  Exact for what ``Encoder`` made; bytes of other lists that are no UTF-8 become U+FFFD."""
    raw = vocabulary.raw
    line = b"".join([raw[i] for i in ids])
    return line[line[:1] == b" ":].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` (array of int) and ``n_ids``.

    Null has no ids, as has the empty text.  Texts are encoded whole.  ``path`` names the model file, which every
    worker must have.  Columns of those names in the input are replaced; repeated rows stay.
    """
    def make(texts: list) -> list:
        lines = encoder(path).encode(texts)
        counts = np.fromiter((len(x) // 4 for x in lines), np.int64, len(lines))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        values = pa.array(np.frombuffer(b"".join(lines), "<u4").astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, values), pa.array(counts)]

    return with_columns(docs, text, {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType()}, make, keep)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null for null ids."""
    fields = [f for f in encoded.schema.fields if f.name != out]
    at = [f.name for f in fields].index(ids)

    def run(batches):
        vocabulary = load_vocabulary(path)
        for batch in batches:
            lists = batch.column(at)
            texts = [None if not x.is_valid else decode_ids(x.values.to_numpy(zero_copy_only=False).tolist(), vocabulary) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in fields] + [out])

    return map_in_arrow(encoded.select(*[f"`{f.name}`" for f in fields]), run, T.StructType([*fields, T.StructField(out, T.StringType())]))


def round_trips(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids, n_ids, ids_crc32`` (of the ids as little-endian 32-bit integers) and ``exact``: whether decoding
    the ids gives the text back (null counts as the empty text)."""
    def make(texts: list) -> list:
        coder = encoder(path)
        lines = coder.encode(texts)
        counts = np.fromiter((len(x) // 4 for x in lines), np.int64, len(lines))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        values = np.frombuffer(b"".join(lines), "<u4")
        exact = [decode_ids(np.frombuffer(x, "<u4").tolist(), coder.vocabulary) == (t or "") for x, t in zip(lines, texts)]
        return [pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32))), pa.array(counts), pa.array([zlib.crc32(x) for x in lines], pa.int64()), pa.array(exact)]

    new = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType(), "ids_crc32": T.LongType(), "exact": T.BooleanType()}
    return with_columns(docs, text, new, make, keep)
