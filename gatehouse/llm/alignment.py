"""Alignment of two tokenizers over a corpus: which ids stand for the same bytes, and how common each pairing is.

Both encode the same bytes, so the offsets at which tokens of both end cut a document into groups.  All tokens of a group are linked pairwise.

1. Identity map: an array from each id of A to the id of B with the same bytes.  Groups of one token on either side are nearly always such
   pairs; each task counts their documents in one vector as long as the vocabulary.
2. All other pairs, the irregular ones, are counted by a shuffle on the pair.
3. Every document then looks up its pairs: identity pairs, and the most common irregular ones, in vectors of bounded size that are sent along; the
   rest, of which no single pair is common, in a join.

A text is cut before a space after something that is no white space, and between a Latin letter and an ASCII sign: tokens of neither vocabulary go
over such a place, so each distinct word is encoded and aligned once in a worker.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.arrow import map_in_arrow, quoted
from gatehouse.llm.pieces import MARK, load_vocabulary
from gatehouse.llm.storage import stored

# Irregular pairs that are sent along to every task: the most common ones.
SENT = 1 << 16
# Words and characters of words that a worker remembers; then it forgets all.
REMEMBERED, CHARACTERS = 400_000, 1 << 24
# Words encoded at a time, and rows of a batch.
WORDS = 4096
ROWS = 256
_SIGN = re.compile(r"[!-/:-@\[-`{-~]")
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_BEFORE = re.compile(rf"(?<=\S)(?= .)|(?<=[{_LATIN}])(?=[!-/:-@\[-`{{-~])", re.S)
_LETTER = " a"  # stands before a word that begins with a sign


def _byte_table() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class _Ragged:
    """Arrays of different lengths, one after another."""

    def __init__(self, width: int) -> None:
        self.ends, self.values, self.n, self.used = np.zeros(1024, np.int64), np.zeros((4096, width), np.int64), 0, 0

    def extend(self, counts: np.ndarray, values: np.ndarray) -> None:
        for name, need in (("ends", self.n + len(counts)), ("values", self.used + len(values))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), np.int64)
                new[:len(old)] = old
                setattr(self, name, new)
        self.ends[self.n:self.n + len(counts)] = self.used + np.cumsum(counts)
        self.values[self.used:self.used + len(values)] = values
        self.n, self.used = self.n + len(counts), self.used + len(values)

    def of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``index``, joined, and their lengths."""
        ends = self.ends[index]
        starts = np.where(index > 0, self.ends[index - 1], 0)
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(index) else np.empty(0, np.int64)
        return self.values[at], sizes


class Aligner:
    """Alignments of the words seen so far.  Word i: its groups as text (``None`` where bytes get lost), counts, identity and irregular links."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        table = _byte_table()
        self.raw_a = [bytes(table[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        vocabulary = load_vocabulary(piece_path)
        self.raw_b = vocabulary.raw
        self.size_b = len(self.raw_b)
        self.length_a, self.length_b = (np.array([len(r) for r in raw]) for raw in (self.raw_a, self.raw_b))
        # The id of B with the bytes of each id of A; -1 if there is none.  Of a byte's two ids, the one that is no byte piece.
        spelled = {}
        for i, raw in enumerate(self.raw_b):
            if raw and (raw not in spelled or i not in vocabulary.byte_ids):
                spelled[raw] = i
        self.same = np.array([spelled.get(raw, -1) for raw in self.raw_a])
        self.names = [f"{a}|{b}" for a, b in enumerate(self.same.tolist())]
        # Pieces of B that go over the start of a word: then texts are taken whole.
        pieces = [p for i, p in enumerate(vocabulary.pieces) if vocabulary.raw[i] and i not in vocabulary.byte_ids]
        self.cut = not any(MARK in p.lstrip(MARK) or any(re.match(f"[{_LATIN}]", x) and _SIGN.match(y) for x, y in pairwise(p)) for p in pieces if not self.b.is_unknown(self.b.piece_to_id(p)))
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.lines: list[str | None] = []
        self.counts = _Ragged(4)  # tokens of A, of B, groups, links
        self.identity = _Ragged(1)  # an id of A for each link
        self.irregular = _Ragged(2)  # a pair of ids as one number, and its links
        self.characters = 0

    def _learn(self, words: list[str]) -> None:
        """Words that begin with a space go in one text, as do those that begin with a sign; what ends in white space goes alone."""
        runs: dict[str, list[str]] = {"": [], _LETTER: []}
        for w in words:
            before = "" if w[0] == " " else _LETTER
            if w[-1].isspace() or not self.cut:
                self._run([w], before)
            else:
                runs[before].append(w)
        for before, part in runs.items():
            for i in range(0, len(part), WORDS):
                self._run(part[i:i + WORDS], before)

    def _run(self, words: list[str], before: str) -> None:
        raw = [(before + w).encode("utf-8", "surrogatepass") for w in words]
        whole, bounds = b"".join(raw), np.cumsum([len(r) for r in raw])
        text = whole.decode("utf-8", "replace")
        ids_a = self.a.encode(text, add_special_tokens=False).ids
        ids_b = self.b.encode(text[1:])
        sound = b"".join([self.raw_a[i] for i in ids_a]) == whole == b"".join([self.raw_b[i] for i in ids_b])
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b]) if ids_b else np.empty(0, np.int64)
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        starts = np.concatenate([[0], bounds[:-1]]) + len(before)
        if not sound or not np.isin(bounds, both).all() or before and not np.isin(starts, both).all():
            if len(words) > 1:  # look for the word in which bytes get lost
                half = len(words) // 2
                self._run(words[:half], before)
                self._run(words[half:], before)
            else:
                self._keep(words, [None], np.zeros((1, 4), np.int64), np.empty((0, 2), np.int64), np.empty((0, 3), np.int64))
            return
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        n_a, n_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        word = np.searchsorted(bounds, both)
        counted = ~np.isin(both, starts) if before else np.ones(len(both), bool)
        regular = (n_a == 1) & (n_b == 1) & (self.same[ids_a[first_a]] == ids_b[first_b])
        names = [self.names[a] for a in ids_a[first_a].tolist()]
        same, other = [np.stack([word, ids_a[first_a]], axis=1)[regular & counted]], []
        for g in np.flatnonzero(~regular & counted).tolist():
            left, right = ids_a[first_a[g]:first_a[g] + n_a[g]].tolist(), ids_b[first_b[g]:first_b[g] + n_b[g]].tolist()
            names[g] = ",".join(map(str, left)) + "|" + ",".join(map(str, right))
            # Repeated ids of a group make one pair with that many links.
            ours, theirs = ([(x, 1) for x in ids] if len(set(ids)) == len(ids) else Counter(ids).items() for ids in (left, right))
            for a, p in ours:
                for b, q in theirs:
                    if self.same[a] == b:
                        same.append(np.array([[word[g], a]] * (p * q)))
                    else:
                        other.append((word[g], a * self.size_b + b, p * q))
        numbers = np.stack([n_a, n_b, np.ones_like(n_a), n_a * n_b], axis=1) * counted[:, None]
        counts = np.add.reduceat(numbers, np.searchsorted(word, np.arange(len(words))), axis=0)
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        skip = 1 if before else 0
        self._keep(words, [";".join(names[i + skip:j]) for i, j in pairwise(cuts)], counts, np.concatenate(same), np.array(other, np.int64).reshape(-1, 3))

    def _keep(self, words: list[str], lines: list, counts: np.ndarray, same: np.ndarray, other: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.lines), len(self.lines) + len(words))))
        self.lines += lines
        self.characters += sum(map(len, words))
        self.counts.extend(np.ones(len(words), np.int64), counts)
        for into, rows in ((self.identity, same), (self.irregular, other)):
            order = np.argsort(rows[:, 0], kind="stable")
            into.extend(np.bincount(rows[:, 0], minlength=len(words)), rows[order, 1:])

    def align(self, texts: list[str | None]) -> "Aligned":
        """A space and each text; no words where a byte of it gets lost."""
        words = [[] if not t else _BEFORE.split(" " + t) if self.cut else [" " + t] for t in texts]
        missing = set().union(*words) - self.index.keys()
        if len(self.index) + len(missing) > REMEMBERED or self.characters > CHARACTERS:
            self._forget()
            missing = set().union(*words)
        self._learn(sorted(missing))
        at = [list(map(self.index.__getitem__, line)) for line in words]
        lines = [[self.lines[i] for i in line] for line in at]
        lost = [None in line for line in lines]
        at = [[] if bad else line for bad, line in zip(lost, at)]
        shas = ["" if bad or not line else hashlib.sha256(";".join(line).encode()).hexdigest() for bad, line in zip(lost, lines)]
        n = len(texts)
        index = np.array([i for line in at for i in line], np.int64)
        doc = np.repeat(np.arange(n), [len(line) for line in at])
        counts = np.zeros((n, 4), np.int64)
        np.add.at(counts, doc, self.counts.of(index)[0])
        ids, sizes = self.identity.of(index)
        same = _grouped(np.repeat(doc, sizes), ids[:, 0], np.ones(len(ids), np.int64), len(self.raw_a), n)
        pairs, sizes = self.irregular.of(index)
        return Aligned(counts, shas, same, _grouped(np.repeat(doc, sizes), pairs[:, 0], pairs[:, 1], len(self.raw_a) * self.size_b, n))


def _grouped(doc: np.ndarray, value: np.ndarray, links: np.ndarray, top: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each document, their links, and the ends of the documents."""
    keys, at = np.unique(doc * top + value, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, links)
    return keys % top, sums, np.concatenate([[0], np.searchsorted(keys, (np.arange(n) + 1) * top)])


class Aligned(NamedTuple):
    counts: np.ndarray
    shas: list[str]
    same: tuple[np.ndarray, np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_DOC = "kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_n array<int>, pairs array<bigint>, pairs_n array<bigint>"


def _align(byte_path: str, piece_path: str):
    """Batches ``doc_id, text`` -> a row of kind 0 for each document; at the end one of kind 1: how many documents hold each identity pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = aligner(byte_path, piece_path)
        held = np.zeros(len(maker.raw_a), np.int64)
        none = np.empty(0, np.int64)

        def batch_of(kind: int, ids: pa.Array, found: Aligned) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x, t)) for (values, sums, ends), t in ((found.same, pa.int32()), (found.pairs, pa.int64())) for x in (values, sums)]
            columns = [pa.array([kind] * len(ids), pa.int32()), ids, *[pa.array(c) for c in found.counts.T], pa.array(found.shas, pa.string()), *lists]
            return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                found = maker.align(batch.column(1).to_pylist())
                held += np.bincount(found.same[0], minlength=len(held))
                yield batch_of(0, batch.column(0), found)
        at = np.flatnonzero(held)
        if len(at):
            one = np.array([0, len(at)])
            yield batch_of(1, pa.nulls(1, pa.int64()), Aligned(np.zeros((1, 4), np.int64), [""], (at, held[at], one), (none, none, np.zeros(2, np.int64))))

    return run


class Known(NamedTuple):
    """What every task gets: documents of each identity pair, the highest count of each id of A, and the most common irregular pairs, sorted."""

    same: np.ndarray
    best: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def _look_up(sent, size_b: int):
    """``row, same, same_n, pairs, pairs_n`` -> ``row, n_best, count_sum, rest, rest_n``; ``rest`` are pairs that were not sent along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = sent.value
        flat = lambda lists: (np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64))
        for batch in batches:
            n = batch.num_rows
            sizes, ids = flat(batch.column(1))
            links = flat(batch.column(2))[1]
            doc = np.repeat(np.arange(n), sizes)
            totals, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(totals, doc, known.same[ids] * links)
            np.add.at(best, doc, np.where(known.same[ids] == known.best[ids], links, 0))
            sizes, pairs = flat(batch.column(3))
            links = flat(batch.column(4))[1]
            doc = np.repeat(np.arange(n), sizes)
            at = np.minimum(np.searchsorted(known.pairs, pairs), max(len(known.pairs) - 1, 0))
            here = known.pairs[at] == pairs if len(known.pairs) else np.zeros(len(pairs), bool)
            count = known.counts[at[here]]
            np.add.at(totals, doc[here], count * links[here])
            np.add.at(best, doc[here], np.where(count == known.best[pairs[here] // size_b], links[here], 0))
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~here], minlength=n))]).astype(np.int32)
            rest, rest_n = (pa.ListArray.from_arrays(pa.array(left), pa.array(x[~here])) for x in (pairs, links))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(totals), rest, rest_n], names=[f"c{i}" for i in range(5)])

    return run


def alignments(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """One row for each row of ``docs``: the key and ``n_a, n_b`` (tokens), ``n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``byte_path`` names a byte-level vocabulary (A, given a space and the text), ``piece_path`` a SentencePiece model (B, which adds the space).  A pair
    of ids counts the documents that link it.  ``n_best`` are the links whose count is the highest of their id of A, ``count_sum`` sums
    the counts over all links.  Texts that are null or empty, or that either tokenizer does not give back byte for byte, have no tokens: zeros and ''.
    Texts are encoded whole.  Repeated rows and repeated or null keys count as documents of their own; other columns are ignored; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    maker = aligner(byte_path, piece_path)
    size_a, size_b = len(maker.raw_a), maker.size_b
    source = docs.select(F.col(quoted(key)).cast("long"), F.col(quoted(text)).cast("string"))
    # The table is written before rows are numbered, so the numbers are the same whenever it is read.
    made = stored(map_in_arrow(source, _align(byte_path, piece_path), _DOC).withColumn("row", F.monotonically_increasing_id()), "alignments")
    rows = made.where("kind = 0")
    identity = made.where("kind = 1").select(F.explode(F.arrays_zip("same", "same_n")).alias("x")).groupBy(F.col("x.same").alias("a")).agg(F.sum("x.same_n").alias("n"))
    pairs = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    top = pairs.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("n").alias("n"))
    # To the driver: vectors as long as A's vocabulary, and ``sent`` pairs at most.
    vector = np.zeros((2, size_a), np.int64)
    for k, part in enumerate((identity, top)):
        for a, n in part.toLocalIterator():
            vector[k, a] = n
    common = sorted(tuple(r) for r in pairs.orderBy(F.col("n").desc(), "pair").limit(sent).collect())
    of = np.array(common, np.int64).reshape(-1, 2)
    known = Known(vector[0], vector.max(axis=0), of[:, 0].copy(), of[:, 1].copy())
    found = stored(map_in_arrow(rows.select("row", "same", "same_n", "pairs", "pairs_n"), _look_up(spark.sparkContext.broadcast(known), size_b),
                                "row long, n_best long, count_sum long, rest array<bigint>, rest_n array<bigint>"), "looked-up")
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_n").alias("links")).join(pairs, "pair")
    best = spark.createDataFrame([(i, int(n)) for i, n in enumerate(known.best) if n], "a int, best long")
    judged = rest.withColumn("a", F.floor(F.col("pair") / size_b).cast("int")).join(F.broadcast(best), "a")
    more = judged.select("row", F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    sums = found.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row")
    return out.select(F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
