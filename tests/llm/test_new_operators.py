"""Alignment, hard negatives and embedding near-duplicates against plain loops."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatehouse.llm import alignment, embedding_dedup, hard_negatives
from gatehouse.llm.forest import Forest
from gatehouse.llm.queries import BYTE_BPE, PIECES
from gatehouse.sources.tables import load

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, unit string, hash string, key long"


# -- alignment ---------------------------------------------------------------------------------------------------------------

A = Tokenizer.from_file(BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def token_bytes():
    table = alignment._byte_table()
    a = [bytes(table[c] for c in A.id_to_token(i)) for i in range(A.get_vocab_size())]
    b = []
    for i in range(B.get_piece_size()):
        piece = B.id_to_piece(i)
        b.append(bytes([int(piece[3:5], 16)]) if B.is_byte(i) else b"" if B.is_control(i) else piece.replace("▁", " ").encode())
    return a, b


RAW_A, RAW_B = token_bytes()


def groups_of(text):
    """Groups of one text, encoded whole; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(RAW_A[i] for i in a) != want or b"".join(RAW_B[i] for i in b) != want:
        return None
    ends = []
    for ids, raw in ((a, RAW_A), (b, RAW_B)):
        total, out = 0, []
        for i in ids:
            total += len(raw[i])
            out.append(total)
        ends.append(out)
    both = sorted(set(ends[0]) & set(ends[1]))
    place = {e: k for k, e in enumerate(both)}
    out = [([], []) for _ in both]
    for side, ids in enumerate((a, b)):
        k = 0
        for i, e in zip(ids, ends[side]):
            out[k][side].append(i)
            k = place.get(e, k - 1) + 1
    return out


def brute_alignment(docs):
    held, made = Counter(), []
    for key, text in docs:
        groups = groups_of(text)
        links = Counter((a, b) for x, y in groups or [] for a in x for b in y)
        held.update(links.keys())
        made.append((key, groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for key, groups, links in made:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        out.append((key, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ODD = ["", None, " ", "  ", "a", " a  b ", "x\n", "\n\nx \n y", "mark ▁ in", "nul \0 in", "it's (so); well,then", "<|endoftext|> and <s>", "é ñ 漢字かな 🙂 é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!!!! ??? --- ***",
       " x　y", "tab\tx", "a\r\nb \r c", "\x1c x", "1234567890 12,5 3.14", "  ,a", ",", "² ².", "word" * 3000, "日本語" * 2000, "x " * 5000, "ab, ab. ab; " * 300]


@pytest.mark.parametrize("sent", [alignment.SENT, 3])
def test_alignment_equals_plain_loop(spark, sent):
    docs = [(r[0], r[1]) for r in load(spark, SF, "documents").select("doc_id", "text").limit(120).collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no key"), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in docs], "doc_id long, text string, pair string, row int, kind int").repartition(5)
    out = alignment.alignments(df, BYTE_BPE, PIECES, sent=sent)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_alignment(docs)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r,.'-()ab1é漢▁"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_apart_are_the_whole_text(text):
    found = alignment.aligner(BYTE_BPE, PIECES).align([text, "in between", text])
    groups = groups_of(text)
    line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
    assert found.shas[0] == found.shas[2] == (hashlib.sha256(line.encode()).hexdigest() if groups else "")


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["one two three", "four, five", "six two", None, "seven▁"]
    maker = alignment.Aligner(BYTE_BPE, PIECES)
    want = [maker.align([t]) for t in texts]
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    got = [maker.align([t]) for t in texts]
    assert [w.shas for w in want] == [g.shas for g in got] and all((w.counts == g.counts).all() for w, g in zip(want, got))


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignments(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE, PIECES).collect() == []


# -- hard negatives ----------------------------------------------------------------------------------------------------------

def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, step=10, scale=256, positives=5, negatives=10):
    rows = list({(k, tuple(math.floor(scale * x) for x in v), label) for k, v, label in rows if label is not None and fine(v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for key, v, label in rows:
        if key is None or key % step:
            continue
        scored = {(dot(v, w), k, other == label) for k, w, other in rows if k != key and len(w) == len(v)}
        for score, k in sorted({(s, k) for s, k, same in scored if same}, key=order)[:positives]:
            hard = sorted({(s, n) for s, n, same in scored if not same and 30 * score <= 100 * s <= 90 * score}, key=order)[:negatives]
            out += [(key, k, i + 1, n, score, s) for i, (s, n) in enumerate(hard)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "u", "h", 1) for k, v, label in rows], SCHEMA)


def random_rows(n, seed, dims=6):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


def f32(rows):
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]


def test_negatives_equal_plain_loop(spark):
    rows = random_rows(300, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1010, [nan] * 6, 1), (1020, [inf] * 6, 0), (1030, [None] * 6, 2), (1040, [], 1), (1050, [0.5] * 6, None), (1060, [0.0] * 6, 1),
             (None, [0.4] * 6, 1), (None, [0.3] * 6, 2), (1070, [0.5, 0.5], 0), (1080, [0.5, 0.25], 0), (1090, [0.4, 0.1], 1)]
    rows += [(2000 + i, rows[7][1], i % 3) for i in range(40)] + [rows[10], rows[11], rows[12]]  # ties and repeated rows
    rows += [(20, [0.1] * 6, 1), (31, [0.3] * 6, 0)]  # keys with two vectors
    rows = f32(rows)
    want = brute_negatives(rows)
    assert len(want) > 500
    out = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, out.collect()), key=repr) == want


def test_negatives_in_many_units(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    monkeypatch.setattr(hard_negatives, "SLICE", 16)
    monkeypatch.setattr(hard_negatives, "CELLS", 64)
    rows = f32(random_rows(200, 2))
    out = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_negatives(rows)


def test_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, None, None)]):
        assert hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("size,dims", [(1, 64), (256, 64), (10**6, 768), (10**8, 5), (10**12, 64), (2**40, 2000), (10**200, 3)])
def test_products_are_exact(size, dims):
    rng = random.Random(size)
    a, b = ([[float(rng.randint(-size, size)) for _ in range(dims)] for _ in range(4)] for _ in range(2))
    a.append([float(size)] * dims)
    b.append([float(-size)] * dims)
    got = hard_negatives.inner_products(np.array(a), np.array(b))
    top = hard_negatives.NO_KEY
    assert got.tolist() == [[max(-top, min(top, sum(int(x) * int(y) for x, y in zip(v, w)))) for w in b] for v in a]


def test_window_is_exact():
    values = [0, 1, 3, 7, 10, 99, 100, 101, 12345, 2**62, -1, -5, -101]
    lo, hi = hard_negatives.window(np.array(values))
    assert lo.tolist() == [-(-30 * v // 100) for v in values] and hi.tolist() == [90 * v // 100 for v in values]


# -- near-duplicates among embeddings ----------------------------------------------------------------------------------------

def brute_near(rows, least=0.98):
    sound = [label is not None and fine(v) and any(v) for _, v, label in rows]
    units = [np.array(v, float) / max(np.linalg.norm(np.array(v, float)), 1e-300) if ok else None for ok, (_, v, _) in zip(sound, rows)]
    near = [[j for j in range(len(rows)) if j != i and sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in group if rows[j][0] is not None]
        seen |= dict.fromkeys(group, min(keys, default=None))
    for i, (k, _, _) in enumerate(rows):
        out.append((k, len(near[i]), seen[i], k is not None and k == seen[i]))
    return sorted(out, key=repr)


def near_rows(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.2, 1.0])).tolist(), int(rng.integers(2))) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [nan] * 16, 1), (1002, [inf] * 16, 1), (1003, [None] * 16, 1), (1004, [0.0] * 16, 1), (1005, [0.0] * 16, 1), (1006, [], 0), (1007, rows[0][1], None), (1008, rows[0][1], None),
             (None, rows[0][1], rows[0][2]), (None, [5.0] * 16, 1), (None, [5.0] * 16, 1), (1009, [1.0, 2.0], 1), (1010, [2.0, 4.0], 1), (1011, [1e-30, 2e-30], 1), (1012, [1e30, 2e30], 1)]
    return f32(rows + [rows[1], rows[2], (3, rows[9][1], 1)])


@pytest.mark.parametrize("part,tile", [(embedding_dedup.PART, embedding_dedup.TILE), (8, 4)])
def test_near_embeddings_equal_plain_loop(spark, monkeypatch, part, tile):
    rows = near_rows()
    monkeypatch.setattr(embedding_dedup.links, "__defaults__", (embedding_dedup.LINK, part))
    monkeypatch.setattr(embedding_dedup.near_pairs, "__defaults__", (tile,))
    got = sorted(map(tuple, embedding_dedup.near_duplicates(vectors(spark, rows)).collect()), key=repr)
    assert got == brute_near(rows)


def test_near_embeddings_recall_on_a_table(spark):
    rows = [(r[0], list(r[1]), r[2]) for r in load(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding", "label").collect()]
    got = {tuple(r) for r in embedding_dedup.near_duplicates(load(spark, "/root/testdata/sf0.1", "embeddings")).collect()}
    assert len(set(brute_near(rows)) & got) >= 0.999 * len(rows)


def test_tables_follow_from_recall():
    for bits in (6, 10, 20):
        n = embedding_dedup.tables_for(bits)
        miss = 1 - (1 - math.acos(0.98) / math.pi) ** bits
        assert miss ** n <= 1e-4 < miss ** (n - 1)


def test_copies_meet_once(spark):
    rows = f32([(i, [1.0, 2.0, 3.0, 4.0], 1) for i in range(5000)] + [(9000 + i, [1.0, 2.0, 3.0, 4.01 + i / 1000], 1) for i in range(30)])
    out = embedding_dedup.near_duplicates(vectors(spark, rows))
    assert {tuple(r)[1:3] for r in out.collect()} == {(5029, 0)}


def test_near_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=40), st.integers(1, 5))
def test_forest(links, cuts):
    f = Forest(20)
    for i in range(cuts):
        part = np.array(links[i::cuts], np.int64).reshape(-1, 2)
        f.join(part[:, 0], part[:, 1])
    root = list(range(20))
    for _ in range(20):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    assert f.root.tolist() == root
