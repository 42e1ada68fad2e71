"""Streams with late and unordered rows against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatehouse.operators import ledger, usage
from gatehouse.streaming import feeds

START = dt.datetime(2024, 3, 1)


def feed_of(spark, folder, triggers, schema):
    """A stream that reads one list of rows a trigger."""
    import os
    import time

    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return feeds.stream_request_feed(spark, os.path.join(str(folder), "*.parquet"), spark.createDataFrame([], schema).schema, files_per_trigger=1)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


EVENTS = "key string, ts timestamp, id long, kind string, amount long"


def balances(df):
    return {r["key"]: (r["credits"], r["total_calls"], r["created_at"], r["last_seen"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_rows_late_by_several_triggers(spark, tmp_path, rocksdb, seed):
    rng = random.Random(seed)
    events = [(rng.choice(["hot", "hot", "a", "b"]), START + dt.timedelta(minutes=10 * i // 3), i, rng.choice(["add", "call", "call", "call", "adjust"]), rng.randint(1, 9)) for i in range(240)]
    events = [(k, t, i, kind, -n if kind == "adjust" and n % 2 else n) for k, t, i, kind, n in events]
    triggers = [[] for _ in range(11)]
    for i, e in enumerate(events):
        triggers[min(i // 30 + rng.choice([0, 0, 0, 1, 2, 3]), 10)].append(e)  # up to three triggers, 400 minutes, late
    triggers = [t for t in triggers if t]
    for t in triggers:
        rng.shuffle(t)
    updates = feeds.run_to_table(feeds.stream_ledger(feed_of(spark, tmp_path / "in", triggers, EVENTS), "8 hours"), "ledger", "update")
    got = balances(feeds.latest_per_key(updates, "key"))
    assert got == balances(ledger.ledger_balances(spark.createDataFrame(events, EVENTS)))
    in_order_of_arrival = {}
    for t in triggers:
        for k, _, _, kind, n in t:
            in_order_of_arrival[k] = ledger.apply_event(in_order_of_arrival.get(k, (0, 0, -1, -1)), kind, n, 0)
    assert any(v[0] != in_order_of_arrival[k][0] for k, v in got.items())


def test_ledger_settles_what_the_watermark_passed(spark, tmp_path, rocksdb):
    at = lambda h: START + dt.timedelta(hours=h)
    triggers = [[("a", at(0), 1, "add", 5)], [("a", at(1), 3, "call", 9), ("b", at(10), 4, "add", 1)], [("b", at(30), 5, "add", 1)], [("a", at(0.5), 2, "add", 100)], [("a", at(31), 6, "call", 2)]]
    updates = feeds.run_to_table(feeds.stream_ledger(feed_of(spark, tmp_path / "in", triggers, EVENTS), "2 hours"), "ledger", "update")
    last = {r["key"]: r for r in feeds.latest_per_key(updates, "key").collect()}
    # The payment of half past twelve came when all up to eight o'clock was settled: it is dropped, and the call of one o'clock stays refused.
    assert last["a"]["credits"] == 3 and last["a"]["total_calls"] == 1
    assert last["a"]["open_events"] == 1 and last["b"]["credits"] == 2
    # Nothing waits longer than the watermark: the settled rows are gone from state.
    assert updates.where("key = 'a'").agg(F.max("open_events")).first()[0] == 2


def test_hours_are_complete_and_late_rows_are_counted(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    schema = "ts timestamp, verdict string"
    triggers = [[(at(0.1), "PASS"), (at(0.2), "FLAG")], [(at(5.5), "BLOCK")], [(at(5.6), "FLAG")], [(at(0.3), "PASS"), (at(0.4), "PASS"), (at(5.1), "PASS"), (at(9.5), None)], [(at(8.2), "PASS"), (at(2), "FLAG")]]
    hours, late = feeds.hourly_table(feed_of(spark, tmp_path / "in", triggers, schema), "2 hours")
    got = {r["hour"]: tuple(r)[1:] for r in hours.collect()}
    assert got == {at(0): (2, 1, 1, 0, False), at(5): (3, 1, 1, 1, False), at(8): (1, 1, 0, 0, True), at(9): (1, 0, 0, 0, True)}
    assert late == 3


def test_payments_are_kept_for_a_day(spark, tmp_path):
    schema = "signature string, attempt_id long, attempted_at timestamp, block_time timestamp, has_meta boolean, wallet_in_tx boolean, lamports long"
    rng = random.Random(3)
    attempts = []
    for s in range(120):  # one payment an hour, tried for a day and beyond
        block = START + dt.timedelta(hours=s)
        attempts += [(f"s{s}", s * 10 + k, block + dt.timedelta(hours=h), block, rng.random() > 0.2, True, rng.choice([50_000, 200_000])) for k, h in enumerate(rng.sample(range(1, 30), 4))]
    attempts.sort(key=lambda a: a[2])
    triggers = [attempts[i:i + 60] for i in range(0, len(attempts), 60)]
    table, run = feeds.run_with_progress(feeds.stream_dedupe_payments(feed_of(spark, tmp_path / "in", triggers, schema)), "dedupe")
    valid = usage.credit_payments(spark.createDataFrame(attempts, schema)).where("valid")
    got = [(r["signature"], r["attempt_id"]) for r in table.collect()]
    assert sorted(got) == sorted((r["signature"], r["attempt_id"]) for r in valid.collect())
    held = [p.stateOperators[0].numRowsTotal for p in run]
    assert max(held) < 80 and held[-1] < 40 and len(got) > 80


def test_ledger_of_many_accounts(spark, tmp_path, rocksdb):
    """10,000 accounts and a hot one in four triggers, every fifth row a trigger late: the state is asked per bucket, not per account."""
    import time

    n = F.col("id")
    events = spark.range(60_000).select(
        F.when(n % 6 == 0, "hot").otherwise(F.concat(F.lit("k"), n * 7919 % 10_000)).alias("key"), F.timestamp_seconds(1_709_251_200 + F.floor(n / 2)).alias("ts"), n.alias("id"),
        F.when(n * 31 % 7 < 2, "add").when(n * 31 % 7 == 2, "adjust").otherwise("call").alias("kind"), F.when(n * 31 % 7 == 2, n % 9 - 6).otherwise(n % 5 + 1).alias("amount"))
    trigger = F.floor(n / 15_000) + (n % 5 == 0).cast("int")
    for k in range(5):
        events.where(trigger == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = feeds.stream_request_feed(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    start = time.time()
    updates = feeds.run_to_table(feeds.stream_ledger(feed, "3 hours", buckets=8), "ledger", "update")
    assert balances(feeds.latest_per_key(updates, "key")) == balances(ledger.ledger_balances(events))
    assert time.time() - start < 60 and updates.where("open_events > 0").count() > 10_000


def test_folding_many_accounts_equals_folding_each(spark):
    import numpy as np

    rng = random.Random(2)
    rows = np.array([(rng.choice([0, 1, 1, 1, 2, 4]), rng.randrange(10**6), i, rng.randrange(3), rng.randint(-9, 9)) for i in range(4000)], feeds._PACKED)
    start = np.array([(c, 0, -1, -1, 0) for c in (0, 0, 10**9, 5, 3)], feeds._ACCOUNT)
    want = [tuple(a)[:4] for a in start]
    for at, us, _, kind, amount in sorted(rows.tolist()):
        want[at] = ledger.apply_event(want[at], ["add", "adjust", "call"][kind], amount, us)
    assert [tuple(a)[:4] for a in feeds._fold(start, feeds._in_order(rows))] == want and tuple(want[3]) == (5, 0, -1, -1)
