"""Document quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it.  Bytes are embedded, learned filters slide over a chunk, and each
filter keeps its largest answer there (max pooling).  A hidden layer turns the pooled answers of a chunk into one logit; the probability
of the document is the logistic function of the mean of its chunks' logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.arrow import crc_mod, quoted, sampled, with_columns
from gatehouse.llm.storage import stored

CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE = 8, 2
EMBEDDING, FILTERS, HIDDEN = 8, 24, 16
FOLDS, HELD_OUT = 3, 1
# Training rows per label, and chunks taken of each: the bound of the sample.
PER_LABEL, CHUNKS_PER_TEXT = 1500, 6
STEPS, BATCH, RATE = 600, 40, 4e-3
SHORTENED = 0.25  # share of training texts cut down to a few words
_BLOCK = 256  # chunks in one matrix product


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks of a text as rows of bytes; the last one ends with zeros, an empty text has one chunk of zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    line = np.zeros((n - 1) * step + CHUNK, np.uint8)
    line[:len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(line, (n, CHUNK), (step, 1))


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # WIDTH * EMBEDDING x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def new(cls, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(normal(256, EMBEDDING, scale=0.5), normal(WIDTH * EMBEDDING, FILTERS, scale=(2 / (WIDTH * EMBEDDING)) ** 0.5), np.zeros(FILTERS, np.float32),
                   normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=HIDDEN ** -0.5), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Embedded windows of chunks: chunks x positions x (WIDTH * EMBEDDING)."""
        e = np.ascontiguousarray(self.embedding[rows]).reshape(len(rows), -1)
        places = (CHUNK - WIDTH) // STRIDE + 1
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(rows), places, WIDTH * EMBEDDING), (s[0], STRIDE * EMBEDDING * s[1], s[1]))

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Largest answer of each filter in each chunk, not below zero."""
        answers = self.windows(rows).reshape(-1, WIDTH * EMBEDDING) @ self.filters
        return np.maximum(answers.reshape(len(rows), -1, FILTERS).max(axis=1) + self.bias, 0)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def score(self, text: str | None) -> float:
        rows = chunks((text or "").encode("utf-8", "replace"))
        total = sum(float(self.logits(rows[i:i + _BLOCK]).sum()) for i in range(0, len(rows), _BLOCK))
        return float(1 / (1 + np.exp(-np.clip(total / len(rows), -30, 30))))

    def gradients(self, rows: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of documents; ``owner`` names the document of each chunk."""
        x = self.windows(rows)
        answers = (x.reshape(-1, WIDTH * EMBEDDING) @ self.filters).reshape(len(rows), -1, FILTERS)
        at = answers.argmax(axis=1)  # chunks x FILTERS
        pooled = np.maximum(np.take_along_axis(answers, at[:, None, :], 1)[:, 0] + self.bias, 0)
        hidden = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        n = np.bincount(owner, minlength=len(y)).astype(np.float32)
        mean = np.bincount(owner, hidden @ self.out + self.out_bias[0], len(y)) / n
        d = ((1 / (1 + np.exp(-mean)) - y) / n / len(y))[owner].astype(np.float32)  # of each chunk's logit
        d_hidden = d[:, None] * self.out * (hidden > 0)
        d_pooled = (d_hidden @ self.hidden.T) * (pooled > 0)
        best = np.take_along_axis(x, at[:, :, None], 1)  # chunks x FILTERS x window: only the largest answers pass gradients on
        d_filters = np.einsum("cf,cfw->wf", d_pooled, best)
        d_best = d_pooled[:, :, None] * self.filters.T[None]
        where = rows[np.arange(len(rows))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, where.ravel(), d_best.reshape(-1, EMBEDDING))
        return [d_embedding, d_filters, d_pooled.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d, np.array([d.sum()], np.float32)]


def _shortened(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A short text cut from one of the chunks, since short documents are rare."""
    row = rows[rng.integers(len(rows))]
    end = int(np.flatnonzero(row)[-1]) + 1 if row.any() else 1
    n = min(end, int(rng.integers(16, 160)))
    start = int(rng.integers(0, end - n + 1))
    out = np.zeros((1, CHUNK), np.uint8)
    out[0, :n] = row[start:start + n]
    return out


def fit(texts: list[list[bytes]], labels: list[int], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on batches with as many documents of one label as of the other; ``texts`` has the sampled chunks of each document."""
    rng, net = np.random.default_rng(seed), Network.new(seed)
    y = np.array(labels)
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    rows = [np.frombuffer(b"".join(t), np.uint8).reshape(-1, CHUNK) for t in texts]
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        chosen = [_shortened(rows[i], rng) if rng.random() < SHORTENED else rows[i] for i in pick]
        owner = np.repeat(np.arange(len(pick)), [len(c) for c in chosen])
        rate = RATE * (1 - step / (steps + 1)) + 1e-5
        for p, g, m, v in zip(net.parts(), net.gradients(np.concatenate(chosen), owner, y[pick]), first, second):
            g = g + 1e-5 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def some_chunks(text: str, n: int = CHUNKS_PER_TEXT) -> list[bytes]:
    """At most ``n`` chunks spread evenly over a whole text; for training only."""
    rows = chunks(text.encode("utf-8", "replace"))
    return [rows[i].tobytes() for i in sorted({k * (len(rows) - 1) // max(1, n - 1) for k in range(n)})]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Network | None:
    """Learns from labelled documents whose crc32(key as text) mod 3 is not 1: about ``per_label`` of each label 0 and 1, by
    hash, and at most six chunks of each (the documented bounds); those chunks come to the driver.  Other and null
    labels are not used.  With one label only, or none, there is no model."""
    k = quoted(key)
    usable = labels.select(F.col(k).alias("key"), F.col(quoted(label)).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull() & (crc_mod(F.col(k), FOLDS) != HELD_OUT))
    # Written first: Spark then knows that the sample is small and sends it to the texts, not the texts to it.
    chosen = stored(sampled(usable.distinct(), "label", "key", per_label), "quality-sample")
    rows = docs.select(F.col(k).alias("key"), F.col(quoted(text)).alias("text")).where(F.col("text").isNotNull()).join(chosen, "key")

    def make(texts: list) -> list:
        return [pa.array([some_chunks(t) for t in texts], pa.list_(pa.binary()))]

    found = sorted((r["label"], [bytes(c) for c in r["chunks"]]) for r in with_columns(rows, "text", {"chunks": T.ArrayType(T.BinaryType())}, make, ["label"]).collect())
    if len({v for v, _ in found}) < 2:
        return None
    return fit([c for _, c in found], [v for v, _ in found])


def score(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), or as ``names`` has it; one row
    out for each row in.

    Null and empty texts are scored as a text of zeros.  Without a model every score is 0.5.  Columns of those names
    in the input are replaced, all others stay.
    """
    def make(texts: list) -> list:
        found = np.array([net.score(t) if net else 0.5 for t in texts], float)
        return [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]

    return with_columns(docs, text, {names[0]: T.DoubleType(), names[1]: T.IntegerType()}, make, keep)
