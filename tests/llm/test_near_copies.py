"""The near-copy stage of the pipeline against planted pairs of known shingle similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gatehouse.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted():
    """Triples ``id, text, id of the original``; each second edit changes single words, each other one cuts the end off."""
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(120):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(150, 700))]
        copy, goal = list(words), rng.uniform(0.6, 0.97)
        while jaccard(" ".join(words), " ".join(copy)) > goal:
            if k % 2:
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            else:
                copy.pop()
        a, b = " ".join(words), " ".join(copy)
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append((2 * k, 2 * k + 1, jaccard(a, b)))
    return rows, pairs


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_near_copies_from_080_up_and_no_others(spark):
    rows, pairs = planted()
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect()}
    assert sum(0.8 <= j < 0.95 for _, _, j in pairs) > 30 and sum(j < 0.8 for _, _, j in pairs) > 30
    assert kept == {a for a, _, _ in pairs} | {b for _, b, j in pairs if j < 0.8}


def test_large_group_in_parts(spark, monkeypatch):
    """A chain of edits, cut into many parts: components are those of all pairs at 0.8 or more."""
    monkeypatch.setattr(near_copies, "GROUP_PART", 4)
    monkeypatch.setattr(near_copies, "PART", 5)
    rng = random.Random(8)
    words, rows = [f"w{rng.randrange(999)}" for _ in range(200)], []
    for k in range(60):
        for _ in range(rng.choice([1, 2, 3, 9])):
            words[rng.randrange(200)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(words)))
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = dict(map(tuple, near_copies.near_copies(frame(spark, rows), "doc_id").collect()))
    assert got == dict(enumerate(root)) and len(set(root)) > 2


@pytest.mark.parametrize("common", [[], range(0, 5000, 3)])
def test_similar_sets_share_a_first_shingle(common):
    rng = np.random.default_rng(6)
    order = near_copies.Order(np.array(common, np.uint64), np.arange(len(common), dtype=np.uint64))
    for _ in range(300):
        a = np.unique(rng.integers(0, 5000, rng.integers(1, 120)).astype(np.uint64))
        b = np.unique(np.where(rng.random(len(a)) < rng.choice([0, 0.05, 0.1, 0.15]), rng.integers(0, 5000, len(a)), a).astype(np.uint64))
        if near_copies.similar(a, b):
            assert set(order.first(a)) & set(order.first(b))
        assert len(order.first(a)) <= len(a) / 5 + 1.01


def test_forest_of_similar_sets():
    rng = np.random.default_rng(7)
    base = [np.unique(rng.integers(0, 10**6, 60).astype(np.uint64)) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 10**6, len(b)), b).astype(np.uint64)) for b in base for _ in range(12)]
    for side in (np.zeros(48, int), np.arange(48) % 2):
        x, y = near_copies.join_similar(sets, side)
        got, want = list(range(48)), list(range(48))
        pairs = [(i, j) for i in range(48) for j in range(i) if near_copies.similar(sets[i], sets[j]) and (not side.any() or side[i] != side[j])]
        assert set(zip(x, y)) <= set(pairs)
        for root, links in ((got, zip(x, y)), (want, pairs)):
            for i, j in links:
                root[:] = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        assert got == want


@pytest.mark.parametrize("small", [near_copies.SMALL, 1, 6])
@pytest.mark.parametrize("size", [7, 1000])
def test_units_over_batches(monkeypatch, small, size):
    """Units of 1 to 60 sets, in batches that cut them: the components of all near pairs."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (5, 2)).astype(np.uint64)
    rows = []
    for unit in range(40):
        for _ in range(rng.choice([1, 2, 3, 10, 60])):
            bits = base[rng.integers(5)].copy()
            for _ in range(rng.integers(0, 24)):
                bits[rng.integers(2)] ^= np.uint64(1) << np.uint64(rng.integers(64))
            rows.append((unit, 0, len(rows), int(rng.integers(80, 130)), *bits.view(np.int64).tolist()))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + size]), kinds)], names=list("abcdef")) for i in range(0, len(rows), size)]
    links = [(a, b) for out in near_copies._propose(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    pairs = []
    for x in rows:
        for y in rows[:x[2]]:
            first, second = (bin((x[k] ^ y[k]) & (2**64 - 1)).count("1") for k in (4, 5))
            if x[0] == y[0] and first <= near_copies.HALF and first + second <= near_copies.RADIUS and min(x[3], y[3]) >= 0.8 * max(x[3], y[3]):
                pairs.append((x[2], y[2]))
    from gatehouse.llm.forest import Forest
    forests = []
    for edges in (links, pairs):
        f = Forest(len(rows))
        at = np.array(edges).reshape(-1, 2)
        f.join(at[:, 0], at[:, 1])
        forests.append(f.root.tolist())
    assert forests[0] == forests[1] and len(set(forests[0])) < len(rows)
