"""Grams of many texts at once: array operations over the bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gatehouse.functions.patterns import WHITE

# Bytes of a gram anywhere in a text; shorter quotes are grams themselves.
GRAM = 8
# Bytes of the grams that begin words, and how many of these in a row choose one.
WORD_GRAM = 12
IN_A_ROW = 4
# Bytes of text in one step.
_STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in WHITE if ord(c) < 128]] = True
_WIDE = [c.encode() for c in WHITE if ord(c) >= 128]
_LEAD = np.zeros(256, bool)
_LEAD[[c[0] for c in _WIDE]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Lines:
    """Texts one after the other as bytes, some zeros behind them; text ``n`` begins at ``at[n]`` and ends at ``at[n + 1]``."""

    def __init__(self, text: np.ndarray, at: np.ndarray):
        self.at, self.size = at, int(at[-1])
        self.text = np.zeros(self.size + WORD_GRAM + GRAM, np.uint8)
        self.text[:self.size] = text[:self.size]

    def eights(self) -> np.ndarray:
        """The eight bytes from each byte on, as a number."""
        return np.ndarray(self.size, "<u8", self.text.data, strides=(1,))

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1

    def strings(self) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(self.at) - 1, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.text[:self.size].tobytes())).cast(pa.string())


def _squeezed(text: np.ndarray, at: np.ndarray) -> Lines:
    """Runs of blanks as one blank, none at either end of a text."""
    blank, keep = _BLANK[text], np.ones(len(text), bool)
    lead = np.flatnonzero(_LEAD[text])
    if len(lead):
        padded = np.concatenate([text, np.zeros(3, np.uint8)])
        for c in _WIDE:
            hit = lead[np.logical_and.reduce([padded[lead + n] == b for n, b in enumerate(c)])]
            blank[hit] = True
            for n in range(1, len(c)):
                keep[hit + n] = False
        text, blank, at = text[keep], blank[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    full = at[:-1] < at[1:]
    before = np.concatenate([[True], blank[:-1]]) if len(blank) else blank
    before[at[:-1][full]] = True
    keep = ~(blank & before)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    text = np.where(blank, np.uint8(32), text)[keep]
    full = at[:-1] < at[1:]
    last = at[1:][full] - 1
    keep = np.ones(len(text), bool)
    keep[last[text[last] == 32]] = False
    return Lines(text[keep], np.concatenate([[0], np.cumsum(keep)])[at])


def squeezed(texts: pa.Array) -> Iterator[tuple[int, Lines]]:
    """Some texts at a time: the number of the first, and the texts with single blanks.  Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(int(np.searchsorted(at, at[first] + _STEP, "right")) - 1, first + 1)
        yield first, _squeezed(data[at[first]:at[end]], at[first:end + 1] - at[first])
        first = end


def chosen(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the grams that begin words (after a blank), of every four in a row the least: whatever text holds a line holds what the line has
    chosen.  Some two grams in five words are chosen, so a text is a few dozen rows and not one for each of its characters.
    """
    start = np.flatnonzero(lines.text[:lines.size] == 32) + 1
    line = lines.of(start - 1)
    fits = start + WORD_GRAM <= lines.at[line + 1]
    start, line = start[fits], line[fits]
    # The last four of the twelve bytes are in both numbers.
    view = np.ndarray(lines.size + WORD_GRAM, "<u8", lines.text.data, strides=(1,))
    x = view[start] * _MIX[0] + view[start + WORD_GRAM - GRAM] * _MIX[1]
    x = (x ^ (x >> np.uint64(30))) * _MIX[2]
    x ^= x >> np.uint64(31)
    some = max(len(x) - IN_A_ROW + 1, 0)
    least = x[:some]
    for n in range(1, IN_A_ROW):
        least = np.minimum(least, x[n:n + some])
    whole = line[:some] == line[IN_A_ROW - 1:]
    line, least = line[:some][whole], least[whole]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (least[1:] != least[:-1])
    return line[new], least[new]


def cut(lines: Lines, n: int) -> np.ndarray:
    """The ``n`` bytes from each byte on, as a number."""
    return lines.eights() & np.uint64((1 << (8 * n)) - 1)


class Asked:
    """Grams that are looked for."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams.astype(np.int64).view(np.uint64))
        bits = max(16, int(16 * len(self.grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.some = np.zeros(1 << bits, bool)
        self.some[(self.grams * _MIX[0]) >> self.shift] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where asked ones are, and which."""
        at = np.flatnonzero(self.some[(grams * _MIX[0]) >> self.shift])
        which = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[which] == grams[at]
        return at[same], which[same]


def held(lines: Lines, asked: dict[int, Asked | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, texts and grams: what each text holds of the grams asked for (None: all) of each size, each once."""
    for n, wanted in asked.items():
        if n == WORD_GRAM:
            line, grams = chosen(lines)
        else:
            line, grams = None, cut(lines, n)
        if wanted is None:
            wanted = Asked(grams.view(np.int64))
        at, which = wanted.find(grams)
        if line is None:
            line = lines.of(at)
            inside = at + n <= lines.at[line + 1]
            line, which = line[inside], which[inside]
        else:
            line = line[at]
        both = np.unique(line * max(len(wanted.grams), 1) + which)
        line, which = np.divmod(both, max(len(wanted.grams), 1))
        yield n, line, wanted.grams[which]


def own(lines: Lines) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, texts and grams by which each text is looked up: what it chooses, or else all its grams of eight bytes, or itself if it is shorter."""
    line, grams = chosen(lines)
    yield WORD_GRAM, line, grams
    length = np.diff(lines.at)
    left = length > 0
    left[line] = False
    for n in range(1, GRAM + 1):
        of = np.flatnonzero(left & ((length == n) if n < GRAM else (length >= n)))
        if len(of):
            starts = length[of] - n + 1
            line = np.repeat(of, starts)
            at = np.repeat(lines.at[of], starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
            yield n, line, cut(lines, n)[at]
