"""Marked words of a SentencePiece vocabulary: what encoding and counting share."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

MARK = "▁"  # stands for a space
# Stands for a mark that was in the text itself.  A lone surrogate cannot be part of a text, so nothing else is hidden.
LITERAL = "\udc81"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
# Characters of text that are cut into words at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[int]
    byte_ids: list[int]
    ids: dict[str, int] = field(compare=False)
    raw: list[bytes] = field(compare=False)  # what each id decodes to

    @classmethod
    def of(cls, rows: list[tuple[str, float, str]]) -> "Vocabulary":
        """``rows``: (piece, score, kind), kind being normal, byte or control."""
        ids, raw, byte_ids = {}, [], [-1] * 256
        for i, (piece, _, kind) in enumerate(rows):
            if kind == "byte":
                b = int(piece[3:5], 16)
                byte_ids[b] = i
                raw.append(bytes([b]))
            elif kind == "control":
                raw.append(b"")
            else:
                raw.append(piece.replace(MARK, " ").encode())
                if MARK not in piece.lstrip(MARK) and ("\n" not in piece or piece == "\n"):  # a piece never goes over the start of a word
                    ids[piece] = i
        return cls([r[0] for r in rows], [round(r[1]) for r in rows], byte_ids, ids, raw)


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; read once in each worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Vocabulary.of([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def char_bytes(c: str) -> bytes:
    return MARK.encode() if c == LITERAL else c.encode("utf-8", "surrogatepass")


def marked_words(text: str) -> Iterator[list[str]]:
    """The marked words of a whole text, in lists of bounded size.  A word takes the marks before it; a line feed is a
    word; there is one mark before the text.  An empty text has no words."""
    if not text:
        return
    line = MARK + text.replace(MARK, LITERAL).replace(" ", MARK)
    at = 0
    while len(line) - at > SLICE:
        cut = line.find(MARK, at + SLICE)
        while cut > 0 and line[cut - 1] == MARK:  # not inside a run of marks
            cut = line.find(MARK, cut + 1)
        if cut < 0:
            break
        yield _WORD.findall(line, at, cut)
        at = cut
    yield _WORD.findall(line, at)


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[list[str | None]]:
    """The texts in runs of about ``size`` characters, one text at least."""
    run, total = [], 0
    for t in texts:
        run.append(t)
        total += len(t or "")
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


class WordCache:
    """Results of words seen by a worker.  When it is full it starts anew: results never depend on it."""

    def __init__(self, compute, limit: int = 300_000) -> None:
        self.compute, self.limit, self.known = compute, limit, {}

    def of(self, words: set[str]) -> dict:
        missing = words - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > self.limit:
                self.known = {}
                missing = words
            self.known.update(self.compute(sorted(missing)))
        return self.known
