"""Jobs whose input has very many copies: the work grows with the input, not with the pairs of copies."""

import itertools
import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gatehouse.functions import grams
from gatehouse.functions.names import jaro_winkler_batch
from gatehouse.functions.patterns import WHITE
from gatehouse.operators import imports, legal, market, pairs, quality, rx, screening, usage
from gatehouse.operators.ledger import apply_event
from gatehouse.sources import reference
from gatehouse.streaming import feeds


def test_bearers_of_a_name_are_not_paired_with_its_matches(spark):
    """200,000 bearers of a name with more than 2,000 matches."""
    letters = F.translate(F.lpad(F.col("id").cast("string"), 4, "0"), "0123456789", "abcdefghij")
    records = spark.range(4000).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("Northern Trading "), letters).alias("name"), F.array().cast("array<string>").alias("aliases"),
                                       F.lit("p").alias("program"), F.lit("entity").alias("entity_type"), F.lit("L").alias("list"))
    names = spark.range(200_000).select(F.col("id").alias("name_id"), F.when(F.col("id") % 1000 == 7, "Quite Else").otherwise("northern trading AAAA").alias("name"))
    few = names.where("name_id < 8")
    listed = {r["name_id"]: tuple(r)[1:] for r in screening.screen_verdicts(few, screening.screen_matches(few, records)).collect()}
    start = time.time()
    got = {tuple(r) for r in screening.screen_names(names, records).select("verdict", "total", "block", "flag", "best_score").distinct().collect()}
    assert time.time() - start < 45
    assert got == {listed[0], listed[7]} and listed[7][:2] == ("PASS", 0) and listed[0][0] == "BLOCK" and listed[0][1] > 2000


def test_rows_of_one_id_count_together(spark):
    records = spark.createDataFrame([("1", "Alpha Omega", [], "p", "entity", "L"), ("2", "Zeta Kappa", [], "p", "entity", "L")],
                                    "record_id string, name string, aliases array<string>, program string, entity_type string, list string")
    names = spark.createDataFrame([(1, "Alpha Omega"), (1, "zeta kappa"), (2, "other"), (3, None), (4, "--")], "name_id int, name string")
    want = sorted(map(tuple, screening.screen_verdicts(names, screening.screen_matches(names, records)).collect()), key=str)
    assert sorted(map(tuple, screening.screen_names(names, records).collect()), key=str) == want and want[0][:3] == (1, "BLOCK", 2)


def test_vulnerabilities_are_counted_per_package(spark):
    """100,000 subjects that import a package with 20,000 vulnerabilities."""
    found = spark.range(100_000).select(F.col("id").alias("subject_id"), F.lit("python").alias("language"), F.explode(F.array(F.lit("rich"), F.lit("bare"))).alias("name"), F.lit("x").alias("raw"))
    found = found.unionByName(spark.createDataFrame([(-1, "cobol", "rich", "x"), (-2, "python", "bare", "x"), (-2, "python", "bare", "y")], found.schema))
    osv = spark.range(20_000).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("id"), F.lit("s").alias("summary"), F.lit("d").alias("details"), F.lit("").alias("db_severity"), F.lit("").alias("score"),
                                     F.array(F.lit("a")).alias("aliases"), F.array(F.struct(F.lit("PyPI").alias("ecosystem"), F.lit("rich").alias("name"))).alias("affected"))
    start = time.time()
    got = imports.vulnerability_summary(found, osv.unionByName(osv.limit(1))).groupBy((F.col("subject_id") >= 0).alias("many"), "total_packages", "vulnerable_packages", "vulnerabilities", "safe").count()
    assert sorted(map(tuple, got.collect())) == [(False, 0, 0, 0, True, 1), (False, 1, 0, 0, True, 1), (True, 2, 1, 20_000, False, 100_000)]
    assert time.time() - start < 45


def test_estimated_keys_lie_within_5_percent(spark):
    """Forty sets of keys of many sizes."""
    log = lambda k: spark.range(1500 * (k + 1)).select(F.concat(F.lit(f"key{k}-"), F.col("id").cast("string")).alias("api_key"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(200).alias("status"))
    parts = [usage.usage_overview(log(k), "2024-01-01 12:00:00", approximate=True) for k in range(40)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    assert [tuple(r) for r in out.collect() if abs(r["active_keys"] - r["total_calls"]) > 0.05 * r["total_calls"]] == []


def test_a_text_is_looked_up_by_few_of_its_grams(spark):
    import random

    random.seed(9)
    word = lambda: "".join(random.choice("abcde") for _ in range(random.randint(1, 9)))
    texts = [(i, " ".join(word() for _ in range(random.randrange(1, 300)))) for i in range(60)] + [(60, "\U0001f642 ab " * 40), (61, "x" * 500), (62, None)]
    asked = []
    for n in range(150):
        text = random.choice(texts[:62])[1]
        k = random.randrange(len(text))
        asked.append((n, text[k:k + random.randrange(1, 120)]))
    want = sorted((n, i) for n, q in asked for i, t in texts if q.strip() and t and " ".join(q.split()) in " ".join(t.split()))
    frames = spark.createDataFrame(asked, "quote_id int, quote string"), spark.createDataFrame(texts, "source_id int, source_text string")
    assert sorted(map(tuple, legal.quote_search(*frames).collect())) == want
    lengths = frames[1].where("source_id < 60").select(F.sum(F.length("source_text")), F.sum(F.size(legal._chosen(F.col("source_text"))))).first()
    assert lengths[1] * 10 < lengths[0]


def test_patients_are_dealt_by_number_not_by_bytes(spark):
    """Few bytes of very many ids are not joined into one task."""
    given = spark.range(4000).select((F.col("id") % 1000).alias("patient_id"), F.col("id").alias("pos"), F.lit("aspirin").alias("name"), F.lit(1.0).alias("dose"), F.lit("mg").alias("unit"), F.lit(1.0).alias("freq"))
    people = spark.range(1000).select(F.col("id").alias("patient_id"), F.lit(70.0).alias("weight_kg"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rx.rx_check(given, reference.medications(spark), reference.interactions(spark), people)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_findings").alias("found")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(t["n"] for t in tasks) == 1000 and sum(t["found"] for t in tasks) == 0


def test_a_member_is_read_once_for_all_schemas_that_judge_it(spark, rows):
    schema = {"anyOf": [{"properties": {"k": {"minimum": 10 * i, "maximum": 10 * i + 1}}} for i in range(10)], "required": ["k", "a.b", "it's"], "not": {"required": ["z"]}}
    docs = rows(['{"k": 41, "a.b": 1, "it\'s": 2}', '{"k": 45, "a.b": null, "a": {"b": 1}}', '{"k": null, "z": null}', "[1]", "{"])
    out = quality.schema_conformance(docs, "id", "x", schema)
    want = [(1, "", "anyOf"), (1, "", "required"), (2, "", "not"), (2, "", "required"), (2, "", "required"), (3, "", "not"), (4, "", "json")]
    assert sorted(map(tuple, out.collect())) == want
    # The document, k and z; two names that are not plain look at the list of names.
    assert out._jdf.queryExecution().analyzed().toString().count("schema_of_variant") == 5


def test_buckets_of_quotes_are_dealt_by_number_not_by_bytes(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    quotes = spark.range(3000).select(F.lit("A").alias("symbol"), F.lit("s").alias("source"), F.col("id").cast("double").alias("price"), at.alias("updated_at"))
    asked = spark.range(3000).select(F.lit("A").alias("symbol"), (at + F.expr("interval 30 seconds")).alias("at"))
    seen = market.quotes_at(asked, quotes).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("at") - F.col("updated_at")).alias("gap"), F.sum("price").alias("p")).collect()
    assert len(seen) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["n"] for r in seen) == 3000
    assert {r["gap"].total_seconds() for r in seen} == {30.0} and sum(r["p"] for r in seen) == sum(range(3000))


class _Held:
    """State of one key, with the number of values that were read and written."""

    def __init__(self):
        self.values, self.moved = [], 0

    def exists(self):
        return bool(self.values)

    def get(self):
        self.moved += len(self.values)
        return iter(self.values)

    def put(self, values):
        self.values, self.moved = list(values), self.moved + len(values)

    def appendList(self, values):  # noqa: N802
        self.put(self.values + list(values))

    def clear(self):
        self.values = []


def test_waiting_ledger_rows_are_read_many_at_a_time():
    import types

    rng, account, waiting = random.Random(4), _Held(), _Held()
    one = types.SimpleNamespace(exists=account.exists, get=lambda: account.values, update=lambda v: setattr(account, "values", v))
    handle = types.SimpleNamespace(getValueState=lambda *_: one, getListState=lambda *_: waiting, registerTimer=lambda _: None)
    ledger = feeds._Ledger()
    ledger.init(handle)
    rows = [(rng.randrange(10**9), i, rng.choice(["add", "call", "adjust"]), rng.randint(-4, 9)) for i in range(30_000)]
    for k in range(0, 30_000, 10_000):
        batch = pd.DataFrame(rows[k:k + 10_000], columns=["us", "id", "kind", "amount"])
        out = list(ledger.handleInputRows(("a",), iter([batch]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert out[0]["open_events"][0] == 30_000
    out = list(ledger.handleExpiredTimer(("a",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 500_000), None))
    state = (0, 0, -1, -1)
    for us, _, kind, amount in sorted(rows):
        state = apply_event(state, kind, amount, us)
    assert tuple(out[0].iloc[0])[1:5] == state and out[0]["open_events"][0] == sum(r[0] >= 500_000_000 for r in rows)
    assert waiting.moved < 100


def _rows_by_task(spark, pairs_of):
    """Pairs per task when no side is sent along."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [r["count"] for r in pairs_of().groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pairs_of_a_hot_package_are_many_tasks(spark):
    """40,000 subjects that import one of two packages with 100 vulnerabilities."""
    found = spark.range(40_000).select(F.col("id").alias("subject_id"), F.when(F.col("id") % 2 == 0, "python").otherwise("javascript").alias("language"), F.concat(F.lit("rich"), F.col("id") % 2).alias("name"), F.lit("x").alias("raw"))
    package = lambda e, n: F.struct(F.lit(e).alias("ecosystem"), F.lit(n).alias("name"))
    osv = spark.range(100).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("id"), F.lit("s").alias("summary"), F.lit("d").alias("details"), F.lit("").alias("db_severity"), F.lit("").alias("score"),
                                  F.array(F.lit("a")).alias("aliases"), F.array(package("PyPI", "rich0"), package("npm", "rich1")).alias("affected"))
    tasks = _rows_by_task(spark, lambda: imports.vulnerabilities(found, osv))
    assert sum(tasks) == 4_000_000 and len(tasks) == 4
    assert imports.vulnerabilities(found, osv).select("subject_id", "id").distinct().count() == 4_000_000


def test_pairs_of_a_hot_name_are_many_tasks(spark):
    """40,000 bearers of two names that are like each of 100 listed ones."""
    letters = F.translate(F.lpad(F.col("id").cast("string"), 2, "0"), "0123456789", "abcdefghij")
    records = spark.range(100).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("Northern Trading House "), letters).alias("name"), F.array().cast("array<string>").alias("aliases"),
                                      F.lit("p").alias("program"), F.lit("entity").alias("entity_type"), F.lit("L").alias("list"))
    names = spark.range(40_000).select(F.col("id").alias("name_id"), F.concat(F.lit("northern trading house AA"), F.col("id") % 2).alias("name"))
    tasks = _rows_by_task(spark, lambda: screening.screen_matches(names, records))
    each = {k: screening.screen_matches(names.where(F.col("name_id") == k), records).count() for k in (0, 1)}
    assert sum(tasks) == 20_000 * (each[0] + each[1]) > 2_000_000 and len(tasks) == 4
    assert screening.screen_matches(names, records).select("name_id", "record_id").distinct().count() == sum(tasks)


def test_a_stream_writes_the_matches_of_a_name_once(spark, tmp_path):
    """3,000 bearers of two names in three batches."""
    records = spark.range(50).select(F.col("id").cast("string").alias("record_id"), F.lit("Northern Trading House").alias("name"), F.array(F.lit("Zeta Kappa")).alias("aliases"),
                                     F.lit("p").alias("program"), F.lit("entity").alias("entity_type"), F.lit("L").alias("list"))
    people = lambda k: spark.range(1000 * k, 1000 * k + 1000).select(F.col("id").alias("name_id"), F.when(F.col("id") % 2 == 0, "northern trading  house").otherwise("Zeta Kapa").alias("name"))
    for k in range(3):
        people(k).coalesce(1).write.parquet(str(tmp_path / "feed" / f"day{k}"))
    feed, out = feeds.stream_request_feed(spark, str(tmp_path / "feed" / "*"), people(0).schema, files_per_trigger=1), str(tmp_path / "out")
    feeds.stream_screen(feed, records, out, str(tmp_path / "mark")).awaitTermination()
    written = sum(spark.read.parquet(str(folder)).count() for folder in (tmp_path / "out").iterdir())
    kinds = feeds.screened(spark, out, records).groupBy("match_type").agg(F.count(F.lit(1)), F.countDistinct("name_id", "record_id")).collect()
    assert sorted(map(tuple, kinds)) == [("exact", 75_000, 75_000), ("fuzzy", 75_000, 75_000)] and written == 3000 + 3 * 2 * 50


def test_block_joins_pair_what_a_join_pairs(spark):
    """Hot and single keys, keys of one side only, null keys, equal rows."""
    rng = random.Random(5)
    key = lambda: rng.choice([None, "hot", "hot", "hot", *"abcdefgh"])
    left = spark.createDataFrame([(key(), rng.randrange(3), i // 2) for i in range(5000)] + [("l", 0, 9)], "k string, n int, x int")
    right = spark.createDataFrame([(key(), rng.randrange(3), rng.choice([None, "v", f"w{i}"]), [i]) for i in range(150)] + [("r", 0, "v", [])], "k string, n int, y string, z array<int>")
    want = sorted(map(tuple, left.join(right, ["k", "n"]).collect()), key=str)
    assert sorted(map(tuple, pairs.join_many(left, right, ["k", "n"]).collect()), key=str) == want
    assert sorted(map(tuple, pairs.join_many(left, right, ["k", "n"], right).collect()), key=str) == want and len(want) > 20_000
    assert pairs.join_many(left, right.limit(0), ["k", "n"], right.limit(0)).count() == 0


def test_names_of_one_form_meet_the_index_once(spark):
    """720 numbers of the same digits, in more than one block, against as many and one that is too long for bits."""
    numbers = ["0123" + "".join(p) for p in itertools.permutations("456789")]
    names = [f"Customer#{n}" for n in numbers] + [" ".join(["northern", "trading"] * 5 + ["house", "of", "a"]), "", "--", None]
    listed = [f"{n} Customer Ltd" for n in numbers[::7]] + [" ".join(["northern", "trading"] * 5 + ["house", "of", "b"]), "??", "Customer"]
    queries = screening.distinct_queries(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "name_id int, name string"))
    records = screening.prepare_list(spark.createDataFrame([(str(i), n, [], "p", "entity", "L") for i, n in enumerate(listed)], "record_id string, name string, aliases array<string>, program string, entity_type string, list string"))
    classes, blocks = screening._classes(queries, "q")
    assert classes.count() == 2 and blocks.count() == 3 and blocks.agg(F.sum(F.size("q_keys"))).first()[0] == 721
    key = lambda df: [r["sort_key"] for r in df.where("sort_key <> ''").collect()]
    full = list(itertools.product(key(queries), key(records)))
    scores = jaro_winkler_batch(pd.Series([a for a, _ in full]), pd.Series([b for _, b in full]))
    got = screening.similar_keys(queries, records, 0.85).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, s) for (a, b), s in zip(full, scores) if s >= 0.85) and len(got) > 50_000


def test_equal_quotes_are_looked_up_once(spark):
    """2,000 bearers of two quotes in 2,000 texts of 30,000 characters: each quote is read once per text, not once per bearer."""
    texts = spark.range(2000).select(F.col("id").alias("source_id"), F.concat(F.repeat(F.lit("lorem ipsum dolor sit "), 1400), F.lit("the very end of it all, at last, "), F.lit("short"), F.col("id") % 2).alias("source_text"))
    asked = spark.range(2000).select(F.col("id").alias("quote_id"), F.when(F.col("id") % 2 == 0, "the  very END of it all, at last").otherwise("t, SHORT0").alias("quote"))
    start = time.time()
    got = legal.quote_search(asked.unionByName(asked.limit(5)), texts.unionByName(texts.limit(5))).agg(F.count(F.lit(1)), F.countDistinct("quote_id", "source_id"), F.sum((F.col("quote_id") % 2) * (F.col("source_id") % 2))).first()
    assert tuple(got) == (3_000_000, 3_000_000, 0) and time.time() - start < 60


def test_blanks_are_squeezed_as_by_regular_expressions(spark, rows):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "b", "é", "“", "日", *WHITE, " "]) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", " ", " ", "x" * 40, WHITE * 3]
    df = rows(texts)
    want = {r["id"]: r["line"] for r in df.select("id", legal._flat(F.coalesce("x", F.lit(""))).alias("line")).collect()}
    assert {r["id"]: r["line"] for r in legal._squeezed(df, "id", "x", "line").collect()} == want


def test_what_a_text_holds_is_found_by_its_bytes(spark):
    """Every quote of a text, of any length, shares what it is looked up by with the text."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcé🙂") for _ in range(rng.randrange(1, 9))) for _ in range(200))
    (_, line), = grams.squeezed(pa.array([text]))
    asked = []
    for k in range(300):
        at = rng.randrange(len(text))
        asked.append(text[at:at + rng.choice([1, 2, 3, 5, 8, 9, 20, 60, 200])].strip() or "a")
    (_, lines), = grams.squeezed(pa.array(asked))
    for n, of, own in grams.own(lines):
        found = {g for size, _, gram in grams.held(line, {n: None}) for g in gram.tolist()}
        assert set(own.tolist()) <= found and len(own) > 0
    assert {int(k) for _, of, _ in grams.own(lines) for k in of} == set(range(300))
