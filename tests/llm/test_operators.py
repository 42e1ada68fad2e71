"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gatehouse.llm import components, decontamination, fingerprints, html_text, language, quality, sentence_pieces, simhash, token_counts, token_ids, url_filter
from gatehouse.llm.pieces import LITERAL, char_bytes, load_vocabulary, marked_words
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = "alpha beta gamma delta epsilon zeta. " * 4000
ODD = [None, "", " ", "\n\t ", "one", "One one ONE", "Ünïcode ▁mark  two ", "😀 日本語。テスト\x00\x1c", "<|endoftext|>, don't x<|STARTOFTEXT|>", LONG, "same text", "same text", "12,34.5 A.B.c '", "a" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a null key, a repeated row, and columns named like results and like internals."""
    rows = [(i, t, "x", 7.5, "y", i) for i, t in enumerate(ODD)] + [(None, "no name", "x", 7.5, "y", 1), (None, None, None, None, None, None), (3, "\n\t ", "x", 7.5, "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, fingerprint string, `odd name.x` int")


def empty(df):
    return df.where("false")


def in_order(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# 1

def test_decontamination_against_plain(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = in_order(decontamination.contamination(docs, items), *columns)
    pairs = lambda df, k: [(r[k], r["text"]) for r in df.collect()]
    assert got == sorted(brute.contamination(pairs(docs, "doc_id"), pairs(items, "item_id")), key=repr)
    assert any(r[-1] for r in got)
    few = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (None, "same TEXT"), (5, "zeta. alpha beta gamma delta epsilon " * 4), (5, "text same"), (6, "one")], "item_id long, text string")
    got = in_order(decontamination.contamination(odd, few), *columns)
    assert got == sorted(brute.contamination(pairs(odd, "doc_id"), pairs(few, "item_id")), key=repr)
    assert not any(r[-1] for r in decontamination.contamination(odd, empty(few)).collect())
    assert decontamination.contamination(empty(odd), few).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "green blue red"), (3, "red x x x x x x x blue green"), (4, "red blue")], "doc_id long, text string")
    index = decontamination.build_index(docs)
    terms = decontamination.phrase_terms(spark.createDataFrame([(1, "red green blue"), (2, "absent red")], "item_id long, text string"))
    found = lambda slop: sorted(r[0] for r in decontamination.proximity_matches(index, terms, slop).join(decontamination.documents_of(index), "row").select("doc").distinct().collect())
    assert found(0) == [2]
    assert found(3) == [1, 2]
    assert found(7) == [1, 2, 3]


# 2

def test_pieces_against_plain():
    coder = sentence_pieces.encoder(PIECES)
    v = coder.vocabulary
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("abcdething sélà\n,.!X") for _ in range(rng.randint(1, 14))).replace(" ", "") for _ in range(400)] + ["▁▁▁", "▁" + LITERAL + "é", "▁梦😀", "\n"]
    got = coder.encode_sorted(sorted(set(words)))
    for w in set(words):
        assert tuple(np.frombuffer(got[w], "<u4")) == brute.viterbi(w, v.ids, v.scores, coder.byte_score, char_bytes, v.byte_ids), w


def test_pieces_round_trip(spark, docs, odd):
    for df in (docs, odd):
        got = sentence_pieces.round_trips(df, PIECES)
        assert got.where("not exact").count() == 0
        back = sentence_pieces.decode(sentence_pieces.encode(df, PIECES), PIECES)
        assert [r for r in in_order(back, "text", "decoded") if (r[0] or "") != r[1]] == []
        assert "odd name.x" in back.columns or df is docs
    assert sentence_pieces.round_trips(empty(odd), PIECES).count() == 0
    assert load_vocabulary(PIECES).pieces[259] == "▁▁"


# 5

def test_token_counts_against_plain(odd, docs):
    v = load_vocabulary(PIECES)
    for df in (odd, docs):
        for r in token_counts.token_counts(df, PIECES).collect():
            words = [w for part in marked_words(r["text"]) for w in part] if r["text"] else []
            assert (r["n_words"], r["n_tokens"]) == (len(words), sum(brute.greedy(w, v.ids, lambda c: len(char_bytes(c))) for w in set(words) for _ in range(words.count(w))))
    assert token_counts.token_counts(empty(odd), PIECES).count() == 0


def test_automaton_small_vocabulary():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 8))}
        automaton = token_counts.Automaton(sorted(pieces))
        for _ in range(60):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 12)))
            assert automaton.count(w) == brute.greedy(w, pieces, lambda c: len(c.encode())), (pieces, w)


# 6

def test_segment_format():
    for ids in ([], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], list(range(3000)), [300] * 5000):
        for bits in (8, 16):
            s = token_ids.Segment(token_ids.pack(np.array(ids, np.uint32), bits))
            assert s.all().tolist() == ids and s.take(np.arange(len(ids))).tolist() == ids
    with pytest.raises(IndexError):
        s.take(np.array([5000]))
    with pytest.raises(ValueError):
        token_ids.Segment(b"none")


def test_token_ids_against_library(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        segments = token_ids.write_ids(df, WORD_BPE)
        got = token_ids.read_documents(segments).collect()
        ids = {}
        for r in rows:
            line = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            ids.setdefault(r["doc_id"], []).append((len(line), zlib.crc32(np.array(line, "<u4").tobytes()), line))
        assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(k), n, c) for k, v in ids.items() for n, c, _ in v)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert keys == sorted(keys)
        if df is docs:
            every = [i for r in sorted(rows, key=lambda r: r["doc_id"]) for i in ids[r["doc_id"]][0][2]]
            places = [0, 1, len(every) - 1, len(every), 77, -1, None, 77]
            found = token_ids.lookup(segments, spark.createDataFrame([(p,) for p in places], "position long")).collect()
            assert sorted(map(tuple, found)) == sorted({(p, every[p]) for p in places if p is not None and 0 <= p < len(every)})
    assert token_ids.read_documents(token_ids.write_ids(empty(odd), WORD_BPE)).count() == 0


# 3

def test_fingerprints(spark, docs, odd):
    for df in (docs, odd):
        got = fingerprints.fingerprint_pairs(df).collect()
        rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        assert len(got) == len(rows)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        if df is docs:
            rows.sort(reverse=True)
            facts = {}
            for k, (key, text) in enumerate(rows):
                half = len(text) // 2
                facts[key] = (len(text), hashlib.sha256((text[:len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest())
            assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == facts
            prints = {r["doc_id"]: r["fingerprint"] for r in got}
            by_text = {}
            for key, text in rows:
                by_text.setdefault(text, set()).add(prints[key])
            assert all(len(v) == 1 for v in by_text.values())
            assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.97
    assert fingerprints.fingerprint_pairs(empty(odd)).count() == 0
    alone = fingerprints.fingerprint_pairs(docs.limit(1)).first()
    assert alone["near_next"] == 1.0


def test_collision_rate(spark):
    """The share of equal samples is near the generalised Jaccard similarity of two weighted sets."""
    rng = random.Random(5)
    a, b = ({f"word{i}": rng.uniform(0.2, 9) for i in rng.sample(range(60), 40)} for _ in range(2))
    rows = [(n, hashlib.md5(t.encode()).digest()[0] * 1000003 + int(t[4:]), w) for n, s in (("a", a), ("b", b)) for t, w in s.items()]
    from pyspark.sql import functions as F

    n = 600
    terms = spark.createDataFrame(rows, "side string, term long, w double").withColumn("lw", F.log("w")).crossJoin(spark.range(n).withColumnRenamed("id", "k"))
    # A row for each sample number, so that the expression stays small.
    value = fingerprints.sample_value(F.xxhash64("term", "k"), F.col("lw"), 0)
    least = terms.groupBy("k").pivot("side", ["a", "b"]).agg(F.min(value))
    same = least.where("a = b").count() / n
    truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs(same - truth) < 4 * (truth * (1 - truth) / n) ** 0.5


# 4

def test_quality(spark, odd):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.train(docs, labels)
    scored = quality.score(docs, net, keep=["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"]]) > 0.95
    got = quality.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["fingerprint"] in ("y", None) for r in got)
    assert quality.score(empty(odd), net).count() == 0
    assert quality.train(empty(docs), labels) is None and quality.train(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.5}


def test_chunks_cover_everything():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 5000):
        raw = bytes(1 + i % 250 for i in range(n))
        rows = quality.chunks(raw)
        step = quality.CHUNK - quality.OVERLAP
        line = b"".join([rows[0].tobytes()] + [r[quality.OVERLAP:].tobytes() for r in rows[1:]])
        assert line[:n] == raw and not any(line[n:]) and (len(rows) == 1 or (len(rows) - 2) * step + quality.CHUNK < n)


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network.new(1)
    rows, owner, y = rng.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 1, 1]), np.array([1, 0])

    def loss():
        z = np.bincount(owner, net.logits(rows)) / np.bincount(owner)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    for p, g in zip(net.parts(), net.gradients(rows, owner, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, h = p[at], 1e-2
        p[at] = kept + h
        up = loss()
        p[at] = kept - h
        down = loss()
        p[at] = kept
        assert abs((up - down) / (2 * h) - g[at]) < 0.08 * abs(g[at]) + 1e-4


# 7

def test_language(spark, odd):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.96
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in got)
    assert language.identify(empty(odd), model).count() == 0
    assert language.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    one = language.train(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.identify(docs.limit(5), one).collect()} == {"de"}
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


# 8

def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rows = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://b.example.net/fr/": ("b.example.net", "/fr/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://example.net": ("example.net", "", None, None),
        "http://notexample.com/de/a": ("notexample.com", "/de/a", None, None),
        "x://example.com/de/#://q": ("example.com", "/de/", "example.com/de/", "block"),
        "https://cheap-pills.example.org/en/1": ("cheap-pills.example.org", "/en/1", None, "block"),
        "https://free-bets.example.com/es/9": ("free-bets.example.com", "/es/9", None, "block"),
        "https://www.thother.example.com/en/5": ("www.thother.example.com", "/en/5", None, "allow"),
        "https://spam-farm.example.org/fr/1": ("spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        "http://h?q=/en/": ("h", "", None, None),
        "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "http://" + "x" * 20000 + "/" + "y" * 20000: ("x" * 20000, "/" + "y" * 20000, None, None),
    }
    df = spark.createDataFrame([(i, u, "mine", "clash") for i, u in enumerate(list(rows) + list(rows)[:2])], "page_id int, url string, other string, verdict string")
    weights = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.filter_urls(df, "url", rules, weights).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        host, path, rule, verdict = rows[r["url"]]
        assert (r["host"], r["path"], r["rule"], r["other"]) == (host, path, rule, "mine")
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(df.where("false"), "url", rules, weights).count() == 0
    assert {r["rule"] for r in url_filter.filter_urls(df, "url", [], weights).collect()} == {None}
    none = url_filter.train(url_filter.labelled_urls(spark).where("false"))
    assert {r["probability"] for r in url_filter.filter_urls(df, "url", [], none).collect()} == {0.5}


# 9

def test_simhash_against_plain(spark, docs, odd):
    for df in (docs, odd.where("doc_id is not null")):
        rows = df.select("doc_id", "text").collect()
        prints = [brute.simhash(r["text"]) for r in rows]
        label = brute.groups([r["doc_id"] for r in rows], prints)
        want = sorted((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, label))
        assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty(odd)).count() == 0


@pytest.mark.parametrize("tile, unit", [(4, 10 ** 6), (64, 7), (3, 2)])
def test_tiles_lose_no_link(spark, tile, unit):
    """Chains of near fingerprints in one large group, cut into small tiles and sub-blocks."""
    rng = random.Random(tile)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:6]:
        for _ in range(25):
            for k in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << k
            values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "simhash long"), tile=tile, unit=unit)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    label = brute.groups(list(range(len(values))), values)
    by_label, by_root = {}, {}
    for v, c in zip(signed, label):
        by_label.setdefault(c, set()).add(v)
        by_root.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 300), (300, 250)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}


# 10

def test_pages(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu, one.</a></ul></nav>
        <div class="cookie-notice">We use cookies, of course.</div><article><h1>A &amp; B</h1><p>First   block,\n with <b>bold</b> text.<br>Same block.<p>Second block &#233;t al.
        <div class="ad">Buy, buy, buy now!</div><form>Name <input></form><p>x</p><section id="comments"><p>I, too, have a long comment to make here.</p></section></article>
        <aside>Related, more.</aside><footer>Foot</footer><script>var t="</p>";</script></body></html>"""
    assert html_text.main_text(page) == "A & B\nFirst block, with bold text. Same block.\nSecond block ét al.\nx"
    plain = "<body><div class=menu><a>One</a> <a>Two</a></div><div><h2>Head</h2><p>" + "Some words, and more. " * 20 + "</p><p>" + "Other words; and more. " * 20 + "</p></div><div><a>Next</a></div></body>"
    assert html_text.main_text(plain).split("\n")[0] == "Head" and html_text.main_text(plain).count("\n") == 2 and "Next" not in html_text.main_text(plain)
    rows = [(1, None, "a"), (2, "", "a"), (3, "no markup at all, only text", "a"), (4, "<p>", "a"), (5, "<div>" * 3000 + "deep" + "</div>" * 10, "a"), (6, page, "a"), (6, page, "a"), (None, "<script>x", "a"), (8, "<p>" + "long text, " * 50000, "a"), (9, "<<>><a <b <!-- <p>x", "a")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert (by[1], by[2], by[4], by[None], by[5]) == ("", "", "", "", "deep") and by[3] == "no markup at all, only text" and len(by[8]) == 549999
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string").where("false")).count() == 0


def test_pages_of_the_tables(spark):
    import html
    import re

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|div|article)\b[^>]*>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)
