"""Language identification by hierarchical discrimination: the family first, then the languages inside it.

Features are hashed byte trigrams of the whole text.  One set of one-versus-one linear support vector machines separates the families;
inside a family, another separates its languages, which have much in common and need weights of their own.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.arrow import crc_mod, quoted, sampled, with_columns

UNDETERMINED = "und"
DIMENSIONS = 4096
# Training rows per language: the bound of the sample.
PER_LANGUAGE = 800
FOLDS, HELD_OUT = 4, 2
_SLICE = 1 << 20

# Families of languages by their two-letter codes; a language outside them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "be", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk"),
    "semitic": ("ar", "he"),
    "indic": ("hi", "bn", "mr", "ur", "pa"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

# Bytes of letters stay; all others are one space.
_LETTER = np.zeros(256, np.uint32)
_LETTER[ord("a"):ord("z") + 1] = np.arange(1, 27)
_LETTER[0x80:] = np.arange(27, 27 + 128)


def family_of(language: str) -> str:
    return _FAMILY.get(language.split("-")[0].lower(), language)


def features(text: str, size: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the trigram shares of a whole text, of length 1; zeros if it has no trigram with a letter."""
    raw = text.lower().encode("utf-8", "replace")
    counts = np.zeros(size)
    for i in range(0, len(raw), _SLICE):
        b = _LETTER[np.frombuffer(raw[max(0, i - 2):i + _SLICE], np.uint8)]
        if i == 0:
            b = np.concatenate([[0], b]).astype(np.uint32)
        if len(b) < 3:
            continue
        x, y, z = b[:-2], b[1:-1], b[2:]
        keep = ((x > 0) + (y > 0) + (z > 0).astype(int)) > 1  # two letters at least
        h = (x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77) ^ z * np.uint32(0xC2B2AE3D))[keep]
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * np.uint32(0x2C1B3C6D) >> np.uint32(12)) % np.uint32(size), minlength=size)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def fit_svm(x: np.ndarray, y: np.ndarray, passes: int = 30, c: float = 10.0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss, by dual coordinate descent.

    ``y`` is 1 or -1; each side counts the same in sum.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, max(1, (y < 0).sum()), max(1, (y > 0).sum())) / max(1, len(y)) * 2
    d = 1 / (2 * c * share)
    q = np.einsum("ij,ij->i", x, x) + d
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + d[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Votes:
    """One-versus-one machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # one row a pair

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> "Votes":
        classes = sorted(set(labels.tolist()))
        pairs = list(itertools.combinations(range(len(classes)), 2))
        rows = []
        for a, b in pairs:
            use = (labels == classes[a]) | (labels == classes[b])
            rows.append(fit_svm(x[use], np.where(labels[use] == classes[a], 1.0, -1.0)))
        return cls(classes, pairs, np.array(rows).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with the most votes (then the greatest sum of margins, then the first), and the mean probability of its pairs."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums, shares = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins):
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            shares[a] += p
            shares[b] += 1 - p
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k], -k))
        return self.classes[best], float(shares[best] / (len(self.classes) - 1))


@dataclass
class Model:
    families: Votes
    languages: dict[str, Votes]
    size: int

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> "Model":
        labels = np.array(labels, object)
        families = np.array([family_of(v) for v in labels], object)
        return cls(Votes.fit(x, families), {f: Votes.fit(x[families == f], labels[families == f]) for f in sorted(set(families.tolist()))}, x.shape[1])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        x = features(text, self.size)
        family, p = self.families.predict(x)
        language, q = self.languages[family].predict(x)
        return language, p * q


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, size: int = DIMENSIONS) -> Model | None:
    """Learns from rows with a label whose crc32(key as text) mod 4 is not 2, at most about ``per_language`` of each
    language (a sample by hash, the documented bound).  Features are computed where the texts are; the sparse rows of
    the sample come to the driver.  Without such a row there is no model."""
    known = docs.where(F.col(quoted(label)).isNotNull() & F.col(quoted(text)).isNotNull() & (crc_mod(F.col(quoted(key)), FOLDS) != HELD_OUT))
    rows = sampled(known.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), F.col(quoted(label)).alias("label")), "label", "key", per_language)

    def make(texts: list) -> list:
        out = []
        for t in texts:
            x = features(t, size)
            at = np.flatnonzero(x)
            out.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes())
        return [pa.array(out, pa.binary())]

    found = sorted((r["label"], bytes(r["x"])) for r in with_columns(rows, "text", {"x": T.BinaryType()}, make, ["label"]).collect())
    if not found:
        return None
    x = np.zeros((len(found), size), np.float32)
    for row, (_, raw) in zip(x, found):
        n = len(raw) // 6
        row[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return Model.fit(x, [v for v, _ in found])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score`` (0 to 1), or as ``names`` has it; one row out for each row in.

    ``und`` with score 0 if the text is null, empty or has no letter, or if there is no model.  Whole texts are read.
    Columns of those names in the input are replaced, all others stay.
    """
    def make(texts: list) -> list:
        found = [model.predict(t) if model else (UNDETERMINED, 0.0) for t in texts]
        return [pa.array([v for v, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]

    return with_columns(docs, text, {names[0]: T.StringType(), names[1]: T.DoubleType()}, make, keep)
