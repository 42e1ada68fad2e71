"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re

import numpy as np
import xxhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall((text or "").translate(_LOW))


def contamination(docs, items, window=13):
    """docs, items: lists of (key, text) -> (key, n_words, n_hit, n_items, sha256, contaminated) of each document."""
    wanted = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k:k + n]), set()).add("" if name is None else str(name))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for k in range(len(w) - n + 1):
                names = wanted.get(tuple(w[k:k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def simhash(text, shingle=4):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").translate(_LOW).encode()) if x]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def groups(keys, prints, radius=4):
    """Least key reachable over links of at most ``radius`` bits."""
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.array(keys)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def greedy(word, pieces, price):
    """Number of longest-match pieces of a word; ``price`` of a character outside."""
    n = i = 0
    longest = max(map(len, pieces), default=0)
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                n, i = n + 1, j
                break
        else:
            n, i = n + price(word[i]), i + 1
    return n


def viterbi(word, ids, scores, byte_score, char_bytes, byte_ids):
    """Best segmentation of one word by all splits of each prefix."""
    best = [(0, ())]
    for i in range(1, len(word) + 1):
        found = None
        for j in range(i - 1, -1, -1):
            k = ids.get(word[j:i])
            if k is not None and (found is None or best[j][0] + scores[k] > found[0]):
                found = (best[j][0] + scores[k], best[j][1] + (k,))
        raw = char_bytes(word[i - 1])
        score = best[i - 1][0] + byte_score * len(raw)
        if found is None or score > found[0]:
            found = (score, best[i - 1][1] + tuple(byte_ids[b] for b in raw))
        best.append(found)
    return best[-1][1]
