"""Depth, length and range have no bound, and no row is dropped."""

import datetime

import pytest
from pyspark.sql import functions as F

from gatehouse.functions.names import normalize_name
from gatehouse.functions.spans import mask
from gatehouse.operators import command_log, config_docs, findings, legal, sql_log, url_log, usage


def rules(df):
    return sorted((r["subject_id"], r["rule_id"]) for r in df.select("subject_id", "rule_id").distinct().collect())


def test_leading_zeros_of_addresses(rows):
    urls = ["http://0x000000000000007f.0.0.1/", "http://00000000000000000177.0.0.1/", f"http://0{'0' * 200}177.1/", f"http://0x{'0' * 99}7f000001/", "http://08.0.0.1/"]
    found = rules(url_log.url_log_findings(rows(urls), "id", "x"))
    for i in range(4):
        assert (i, "NET-LOOPBACK") in found and (i, "NET-MALFORMED-URL") not in found
    assert (4, "NET-LOOPBACK") not in found


@pytest.mark.parametrize("depth", [0, 3, 8, 40])
def test_brackets_in_select_lists(rows, depth):
    deep = "(" * depth + "a" + ")" * depth
    found = rules(sql_log.sql_log_findings(rows([f"SELECT {deep}, * FROM t", f"SELECT {deep}, count({deep}) FROM t", f"SELECT ({deep} * 2) FROM t"]), "id", "x"))
    assert found == [(0, "SQL-SELECT-STAR-NO-LIMIT")]


def test_evidence_is_whole_unless_asked(rows):
    long = "DROP TABLE " + "t" * 500
    shown = lambda **k: sql_log.sql_log_findings(rows([long]), "id", "x", **k).first()["matched"]
    assert shown() == long.upper() and len(shown(evidence=50)) == 50


@pytest.mark.parametrize("depth", [0, 1, 4, 30])
def test_nested_substitutions_are_opaque(rows, depth):
    inner = "rm -rf /"
    for _ in range(depth):
        inner = f"(b; {inner})"
    commands = [f"echo $(a; {inner}); ls", f"echo $(a '(' {inner}) ; rm -rf /", "(cd x; rm -rf /)", f"echo $(a $(b; {inner}))"]
    found = {i for i, rule in rules(command_log.command_log_findings(rows(commands), "id", "x")) if rule == "CMD-RM-RECURSIVE-ROOT"}
    assert 0 not in found and 3 not in found and 1 in found


@pytest.mark.parametrize("depth", [0, 1, 3, 7])
def test_nested_lists(rows, depth):
    doc = '{"kind": "Pod", "metadata": {"name": "p"}, "spec": {"hostNetwork": true}}'
    for _ in range(depth):
        doc = '{"kind": "List", "items": [' + doc + ', {"kind": "Service", "items": [1]}]}'
    assert (0, "K8S-HOST-NETWORK") in rules(config_docs.k8s_findings(rows([doc]), "id", "x"))


def test_compatibility_characters(rows):
    cases = {"Henry Ⅷ": "HENRY VIII", "𝐀cme": "ACME", "℡ Co": "TEL CO", "½ Inc": "1 2 INC", "㏏": "KT", "SÍNALOA cartél": "SINALOA CARTEL", "ﬃx Ⅷ Ⅷ": "FFIX VIII VIII", "plain": "PLAIN", "日本": ""}
    got = rows(list(cases)).select(normalize_name(F.col("x"))).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_masks_keep_their_length(rows):
    assert rows(["a" * 300 + "-b"]).select(mask(F.col("x"))).first()[0] == "*" * 300 + "-*"


def test_quotes_without_source_stay(spark):
    quotes = spark.createDataFrame([(1, 1, "a b"), (2, 9, "a b"), (3, 1, "c"), (4, 2, "x")], "quote_id int, source_id int, quote string")
    sources = spark.createDataFrame([(1, "x A  b y"), (2, None)], "source_id int, source_text string")
    got = {r["quote_id"]: (r["found"], r["verdict"]) for r in legal.quote_fidelity(quotes, sources).collect()}
    assert got == {1: (True, "PASS"), 2: (None, None), 3: (False, "BLOCK"), 4: (None, None)}


def test_window_ends_at_as_of(spark):
    log = spark.createDataFrame([(i, datetime.datetime(2024, 1, 19) + datetime.timedelta(hours=i), "v", "/p" if i % 2 else "/q") for i in range(240)], "id int, ts timestamp, verdict string, path string")
    assert usage.in_window(log, "2024-01-20 00:00:00").count() == 25
    page = usage.request_page(log, 1500, 2, path="/p").collect()
    assert len(page) == 118 and page[0]["id"] == 235
    for bad in ((0, 0), (5, -1)):
        with pytest.raises(ValueError):
            usage.request_page(log, *bad)


def test_pipeline_flags_go_on(spark):
    subjects = spark.createDataFrame([(i,) for i in range(4)], "subject_id int")
    table = lambda rows: spark.createDataFrame(rows, "subject_id int, verdict string")
    stages = [("a", table([(0, "BLOCK"), (1, "FLAG")]), 1), ("b", table([(1, "FLAG"), (2, "FLAG")]), 2, subjects.where("subject_id in (0, 1)")), ("c", table([(2, "BLOCK")]), 4)]
    got = {r["subject_id"]: (r["passed"], r["blocked_at"], r["credits_used"]) for r in findings.staged_pipeline(subjects, stages).collect()}
    assert got == {0: (False, "a", 1), 1: (True, None, 7), 2: (False, "c", 5), 3: (True, None, 5)}


def test_quotes_are_found_anywhere(spark):
    quotes = spark.createDataFrame([(1, "Ne two  three fo"), (2, "wo three four five six sev"), (3, "three"), (4, "hree"), (5, ""), (6, "four two"), (7, None), (8, "absent words here"),
                                    (9, "the court"), (10, "court"), (11, "he ruled"), (12, "t"), (13, "  "), (14, "court."), (3, "three"), (15, "🙂 oü")], "quote_id int, quote string")
    sources = spark.createDataFrame([(1, "one two three four five six seven"), (2, "ONE\ntwo three"), (3, None), (4, ""), (5, "As he ruled, it went before the court."), (6, "x 🙂 Oüy")], "source_id int, source_text string")
    got = sorted(map(tuple, legal.quote_search(quotes, sources).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (9, 5), (10, 5), (11, 5), (12, 1), (12, 2), (12, 5), (14, 5), (15, 6)]
    assert legal.quote_search(quotes.where("quote_id in (5, 7, 13)"), sources).collect() == [] and legal.quote_search(quotes, sources.where("false")).collect() == []


def test_common_quotes_are_read_where_their_rarest_gram_is(spark):
    """Quotes and sources that share much, against plain inclusion."""
    import random

    random.seed(5)
    line = lambda n: "".join(random.choice("ab ") for _ in range(n))
    texts = [(i, line(400) + "the same end of every text") for i in range(60)]
    asked = [(i, random.choice(texts)[1][k:k + n]) for i, (k, n) in enumerate((random.randrange(400), random.randrange(1, 20)) for _ in range(80))] + [(100, "the same end of every"), (101, "a" * 30)]
    flat = lambda t: " ".join(t.split())
    want = sorted((q, s) for q, x in asked for s, t in texts if flat(x) and flat(x) in flat(t))
    got = legal.quote_search(spark.createDataFrame(asked, "quote_id int, quote string"), spark.createDataFrame(texts, "source_id int, source_text string"))
    assert sorted(map(tuple, got.collect())) == want


def test_grams_of_a_long_text_take_linear_time(spark):
    import time

    sources = spark.range(1).select(F.col("id").alias("source_id"), F.concat(F.repeat(F.lit("lorem ipsum dolor "), 60_000), F.lit("the very end")).alias("source_text"))
    start = time.time()
    assert legal.quote_search(spark.createDataFrame([(1, "r the very e")], "quote_id int, quote string"), sources).count() == 1
    assert time.time() - start < 60
