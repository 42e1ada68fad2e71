"""Token counts without tokens: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie.  Where a character does not continue the current node, the automaton follows the failure link of the node: the
node for what is left of the read text once the longest matches at its front are taken off, whose number (the popped
count) is stored with the link.  So every character is read once, and no piece is ever built.

A character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gatehouse.llm.arrow import with_columns
from gatehouse.llm.pieces import WordCache, char_bytes, load_vocabulary, marked_words, slices


class Automaton:
    def __init__(self, pieces: list[str]) -> None:
        known = set(pieces)
        # Every character of a piece is matched on its own at least, at the price of its bytes if it is no piece.
        price = {p: 1 for p in known if p} | {c: len(char_bytes(c)) for p in known for c in p if c not in known}
        self.children: list[dict[str, int]] = [{}]
        end = [0]
        for piece, n in price.items():
            at = 0
            for c in piece:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    end.append(0)
                at = nxt
            end[at] = n
        self.link = [0] * len(self.children)
        self.popped = [0] * len(self.children)
        level = [(0, c, v) for c, v in self.children[0].items()]
        while level:
            below = []
            for parent, c, v in level:
                if end[v]:
                    self.link[v], self.popped[v] = 0, end[v]
                else:  # one character is always a match, so v is no child of the root
                    z, n = self.link[parent], self.popped[parent]
                    while c not in self.children[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    self.link[v], self.popped[v] = self.children[z][c], n
                below += [(v, d, w) for d, w in self.children[v].items()]
            level = below
        self.cache = WordCache(lambda words: {w: self.count(w) for w in words})

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of one word."""
        children, link, popped = self.children, self.link, self.popped
        first, at, n = children[0], 0, 0
        for c in word:
            nxt = children[at].get(c)
            while nxt is None:
                if c not in first:
                    while at:
                        n += popped[at]
                        at = link[at]
                    n += len(char_bytes(c))
                    break
                n += popped[at]
                at = link[at]
                nxt = children[at].get(c)
            else:
                at = nxt
        while at:
            n += popped[at]
            at = link[at]
        return n


@functools.lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton(list(load_vocabulary(path).ids))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words`` and ``n_tokens`` of the whole text.

    Null and empty texts have none of either.  Words are the marked words of the vocabulary file ``path``.  Columns of
    those names in the input are replaced; repeated rows stay.
    """
    def make(texts: list) -> list:
        counter, words, tokens = automaton(path), [], []
        for run in slices(texts):
            lists = [list(marked_words(t)) if t else [] for t in run]
            known = counter.cache.of({w for parts in lists for part in parts for w in part})
            words += [sum(map(len, parts)) for parts in lists]
            tokens += [sum(sum(map(known.__getitem__, part)) for part in parts) for parts in lists]
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return with_columns(docs, text, {"n_words": T.LongType(), "n_tokens": T.LongType()}, make, keep)
