"""Queries over the request log, payments, the ledger and their streaming forms."""

from __future__ import annotations

import functools
import os

from pyspark.sql import functions as F

from gatehouse.operators import ledger, usage
from gatehouse.plans.inputs import ctes, load, table
from gatehouse.plans.text import ORACLE as TEXT_ORACLE
from gatehouse.sources import reference, request_log, snapshots
from gatehouse.streaming import feeds

PII_REDACT = TEXT_ORACLE["pii_redact"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

AS_OF = "2024-01-20 00:00:00"
_LOG = f"with {ctes('request_log')}"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _log(spark, d):
    return load(spark, d, "request_log")


# Every table, with a column to sum.
_TABLE_SUMS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "user_id",
               "documents": "n_chars", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "turn"}


@query("load_tables", " union all ".join(f"select '{t}' as name, count(*) as n, sum({c}) as total from {t}" for t, c in _TABLE_SUMS.items()))
def _(spark, d):
    from gatehouse.sources.tables import load as read
    parts = [read(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("total")) for t, c in _TABLE_SUMS.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query("request_log_roundtrip", f"{_LOG} select strftime(ts, '%Y-%m-%d') as day, count(*) as n, sum(status) as s from request_log where ts >= timestamp '{AS_OF}' group by 1")
def _(spark, d):
    """Write the dated table, read it back pruned by date."""
    path = os.path.join(feeds.work_folder(spark, "log"), "log")
    request_log.write_request_log(_log(spark, d), path)
    return request_log.read_request_log(spark, path, since=AS_OF).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("status").alias("s"))


@query("sanctions_snapshot", """select 'X-' || s_suppkey as record_id, case when s_suppkey % 10 = 0 then s_name || ' v2' else s_name end as name,
    case s_suppkey % 4 when 0 then 'individual' when 1 then 'entity' when 2 then 'vessel' else 'unknown' end as entity_type, case when s_suppkey % 3 <> 0 then 'P' || s_nationkey end as program,
    case when s_suppkey % 5 = 0 then 'AKA, "' || s_suppkey || '"|Second' when s_suppkey % 5 = 1 then 'AKA, "' || s_suppkey || '"' else '' end as aliases from supplier""")
def _(spark, d):
    """CSV files in the published layout, with duplicates, quoted fields and empty markers, then the ETL."""
    folder = feeds.work_folder(spark, "snapshot")
    s = table(spark, d, "supplier")
    kind = F.when(F.col("s_suppkey") % 4 == 0, "Individual").when(F.col("s_suppkey") % 4 == 1, "-0- ").when(F.col("s_suppkey") % 4 == 2, "VESSEL").otherwise("robot")
    row = lambda name, when: F.when(when, F.struct(F.col("s_suppkey").cast("string").alias("a"), name.alias("b"), kind.alias("c"),
                                                   F.when(F.col("s_suppkey") % 3 == 0, "-0-").otherwise(F.concat(F.lit("P"), "s_nationkey")).alias("d")))
    twice = F.filter(F.array(row(F.col("s_name"), F.lit(True)), row(F.concat("s_name", F.lit(" v2")), F.col("s_suppkey") % 10 == 0)), lambda x: x.isNotNull())
    rows = s.select(F.explode(twice).alias("r")).select("r.*")
    blank = spark.range(1).select(F.lit("-0-").alias("a"), F.lit("nobody").alias("b"), F.lit("").alias("c"), F.lit("").alias("d"))
    rows.unionByName(blank).write.option("quote", '"').option("escape", '"').csv(folder + "/prim")
    alias = lambda n, when: F.when(when, F.struct(F.col("s_suppkey").cast("string").alias("a"), F.lit("1").alias("b"), F.lit("aka").alias("c"), n.alias("d")))
    first = F.concat(F.lit('AKA, "'), "s_suppkey", F.lit('"'))
    many = F.filter(F.array(alias(first, F.col("s_suppkey") % 5 < 2), alias(first, F.col("s_suppkey") % 5 < 2), alias(F.lit("Second"), F.col("s_suppkey") % 5 == 0),
                            alias(F.lit("-0-"), F.lit(True))), lambda x: x.isNotNull())
    s.select(F.explode(many).alias("r")).select("r.*").write.option("quote", '"').option("escape", '"').csv(folder + "/alt")
    out = snapshots.build_sanctions_snapshot(spark, folder + "/prim", folder + "/alt", "X")
    return out.select("record_id", "name", "entity_type", "program", F.array_join("aliases", "|").alias("aliases"))


@query("usage_overview", f"""{_LOG} select count(*) as total_calls, count(distinct api_key) as active_keys, round(avg(case when status >= 400 then 1.0 else 0 end), 9) as error_rate
    from request_log where ts between timestamp '{AS_OF}' - interval 24 hours and timestamp '{AS_OF}'""")
def _(spark, d):
    return usage.usage_overview(_log(spark, d), AS_OF).withColumn("error_rate", F.round("error_rate", 9))


@query("usage_overview_approx", f"{_LOG} select count(*) as total_calls, true as within_5_percent from request_log where ts between timestamp '{AS_OF}' - interval 8760 hours and timestamp '{AS_OF}'")
def _(spark, d):
    """The estimate of active keys against the exact count."""
    rough, exact = (usage.usage_overview(_log(spark, d), AS_OF, hours=24 * 365, approximate=a) for a in (True, False))
    near = F.abs(F.col("rough") - F.col("active_keys")) <= 0.05 * F.col("active_keys")
    return exact.join(rough.select(F.col("total_calls"), F.col("active_keys").alias("rough")), "total_calls").select("total_calls", near.alias("within_5_percent"))


@query("calls_per_hour", f"{_LOG} select strftime(ts, '%Y-%m-%d %H:00') as hour, count(*) as calls from request_log group by 1")
def _(spark, d):
    return usage.calls_per_hour(_log(spark, d)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00"))


@query("calls_by_endpoint", f"{_LOG} select path, count(*) as calls from request_log group by 1")
def _(spark, d):
    return usage.calls_by_endpoint(_log(spark, d))


@query("verdict_distribution", f"""{_LOG} select count(*) filter (verdict = 'PASS') as pass, count(*) filter (verdict = 'FLAG') as flag, count(*) filter (verdict = 'BLOCK') as block,
    round(count(*) filter (verdict = 'BLOCK') * 100.0 / count(*), 9) as block_rate from request_log""")
def _(spark, d):
    return usage.verdict_distribution(_log(spark, d)).withColumn("block_rate", F.round("block_rate", 9))


_TOP = "p as (select coalesce(language, 'unknown') as language, unnest(hallucinated_packages) as name from request_log)"


@query("top_hallucinated_packages", f"{_LOG}, {_TOP} select language, name, count(*) as n from p group by all order by n desc, language, name limit 20")
def _(spark, d):
    return usage.top_hallucinated_packages(_log(spark, d))


@query("check_type_breakdown", f"{_LOG} select check_type, count(*) as n from (select unnest(check_types) as check_type from request_log) group by 1")
def _(spark, d):
    return usage.check_type_breakdown(_log(spark, d))


@query("request_page", f"{_LOG}, p as (select * from request_log where verdict = 'BLOCK' and path = '/v1/verify' order by ts desc, id desc limit 1500 offset 30) select id, path, verdict from p")
def _(spark, d):
    """The page is the feature: so many of the rows that pass the filters."""
    return usage.request_page(_log(spark, d), 1500, 30, "/v1/verify", "BLOCK").select("id", "path", "verdict")


_PRICE = "case path when '/v1/verify' then 2 when '/v1/finance/order/risk' then 5 else 1 end"


@query("price_usage", f"{_LOG} select path, count(*) as calls, count(*) * {_PRICE} as credits, round(count(*) * {_PRICE} * 0.0001, 9) as revenue_sol from request_log group by path")
def _(spark, d):
    return usage.price_usage(_log(spark, d)).withColumn("revenue_sol", F.round("revenue_sol", 9))


@query("free_tier_quota", f"{_LOG} select id, ip, row_number() over (partition by ip order by ts, id) <= 10 as allowed from request_log where api_key is null")
def _(spark, d):
    return usage.free_tier_quota(_log(spark, d)).select("id", "ip", "allowed")


@query("credit_payments", f"""with {ctes('payment_attempts')}, o as (select *, case when block_time is null then 'missing_block_time'
      when epoch(attempted_at) - epoch(block_time) > 86400 then 'transaction_too_old' when not has_meta then 'missing_tx_meta' when not wallet_in_tx then 'service_wallet_not_in_tx'
      when lamports <= 0 then 'no_sol_sent_to_service_wallet' when lamports < 100000 then 'amount_too_small' end as own from payment_attempts),
    f as (select *, sum(case when own is null then 1 else 0 end) over (partition by signature order by attempted_at, attempt_id rows between unbounded preceding and 1 preceding) as before from o),
    e as (select *, case when coalesce(before, 0) > 0 then 'already_used' else own end as error from f)
    select signature, attempt_id, error is null as valid, case when error is null then lamports // 100000 else 0 end as credits, error from e""")
def _(spark, d):
    return usage.credit_payments(load(spark, d, "payment_attempts"))


_EVENTS = f"{ctes('ledger_events')}, o as (select *, row_number() over (partition by key order by ts, id) as rn from ledger_events)"
_FOLD = f"""with recursive {_EVENTS},
    w as (select key, rn, case when kind = 'call' then (case when amount <= 0 then -amount else 0 end) else greatest(amount, 0) end as credits,
                 case when kind = 'call' and amount <= 0 then 1 else 0 end as calls, case when kind <> 'call' or amount <= 0 then ts end as created, case when kind <> 'call' or amount <= 0 then ts end as seen from o where rn = 1
          union all select o.key, o.rn, case when kind = 'call' then (case when w.credits >= amount then w.credits - amount else w.credits end) else greatest(w.credits + amount, 0) end,
                 w.calls + case when kind = 'call' and w.credits >= amount then 1 else 0 end,
                 coalesce(w.created, case when kind <> 'call' or w.credits >= amount then ts end), case when kind <> 'call' or w.credits >= amount then ts else w.seen end
          from w join o on o.key = w.key and o.rn = w.rn + 1),
    last as (select w.* from w join (select key, max(rn) as rn from o group by key) m using (key, rn) where created is not null)"""


def _ledger(spark, d):
    return ledger.ledger_balances(load(spark, d, "ledger_events"))


def _stamp(df):
    for c in ("created_at", "last_seen"):
        df = df.withColumn(c, F.unix_micros(c))
    return df


@query("ledger_balances", f"{_FOLD} select key, credits, calls as total_calls, epoch_us(created) as created_at, epoch_us(seen) as last_seen from last")
def _(spark, d):
    return _stamp(_ledger(spark, d))


@query("ledger_totals", f"{_FOLD} select count(*) as accounts, cast(sum(credits) as bigint) as total_credits, cast(sum(calls) as bigint) as total_calls from last")
def _(spark, d):
    return usage.ledger_totals(_ledger(spark, d))


@query("service_health", f"""with {ctes('probes')}, l as (select *, row_number() over (partition by service order by ts desc) as r from probes)
    select service, case when http_status is null then 'down' when http_status not between 200 and 399 then 'degraded' when latency_ms < 200 then 'ok' when latency_ms < 1000 then 'degraded' else 'down' end as status,
    latency_ms from l where r = 1""")
def _(spark, d):
    return usage.service_health(load(spark, d, "probes")).drop("last_checked")


@query("union_snapshots", """select 'S-' || s_suppkey as record_id, s_name as name, 'S' as list, 0 as part from supplier
    union all select 'C-' || c_custkey, c_name, 'C', 1 from customer""")
def _(spark, d):
    """Two lists as one; ``part`` keeps their order."""
    row = lambda t, p, key, name: table(spark, d, t).select("*", F.concat(F.lit(f"{p}-"), key).alias("record_id"), F.col(name).alias("name"), F.lit(p).alias("list"))
    parts = [row("supplier", "S", "s_suppkey", "s_name"), row("customer", "C", "c_custkey", "c_name")]
    return snapshots.union_snapshots([p.select("record_id", "name", "list") for p in parts])


# Streaming: the same rows as a stream must give the batch result.
def _feed(spark, d, name="events"):
    # A glob works for a single file and for a folder of part files; the file source takes no plain file.
    path = os.path.join(d, f"{name[:-1]}[{name[-1]}].parquet")
    return feeds.stream_request_feed(spark, path, table(spark, d, name).schema)


def _stream_input(spark, d, name):
    from gatehouse.plans.inputs import INPUTS
    from gatehouse.session import ensure_utc
    ensure_utc(spark)
    return spark.sql(INPUTS[name].replace("ARR(", "array("), events=_feed(spark, d))


CHUNK_DAYS = 5
# Longer than a row of a feed can be late: its own chunk and the next.
LATENESS = f"{2 * CHUNK_DAYS + 1} days"


def _chunked_input(spark, d, name, late=False):
    """As :func:`_stream_input`, with the events arriving over several triggers, in the order of their chunks of days; with ``late``, every
    seventh event one chunk later than it should."""
    from gatehouse.plans.inputs import INPUTS
    from gatehouse.session import ensure_utc
    ensure_utc(spark)
    events, path = table(spark, d, "events"), os.path.join(feeds.work_folder(spark, "chunks"), "events")
    files = spark.sparkContext.defaultParallelism
    part = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (86400 * CHUNK_DAYS)) + (F.col("event_id") % 7 == 0).cast("int") * int(late)
    # Chunks of the time span of the table; files of a chunk are read in one trigger.
    for k in sorted(r[0] for r in events.select(part.alias("p")).distinct().collect()):
        events.where(part == k).repartition(files).write.mode("append").parquet(path)
    feed = feeds.stream_request_feed(spark, path, events.schema, files_per_trigger=files)
    return spark.sql(INPUTS[name].replace("ARR(", "array("), events=feed)


@query("stream_request_feed", f"{_LOG} select id, path, status, verdict from request_log")
def _(spark, d):
    return feeds.run_to_table(_stream_input(spark, d, "request_log").select("id", "path", "status", "verdict"), "feed")


@query("stream_calls_per_hour", f"""{_LOG} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') as hour, count(*) as calls, count(*) filter (verdict = 'PASS') as passed, count(*) filter (verdict = 'FLAG') as flagged,
    count(*) filter (verdict = 'BLOCK') as blocked, 0 as late from request_log group by 1""")
def _(spark, d):
    """All hours; ``late`` counts the rows of the run that came after their hour was closed."""
    out, late = feeds.hourly_table(_chunked_input(spark, d, "request_log", late=True), LATENESS)
    return out.drop("open").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00")).withColumn("late", F.lit(late))


@query("stream_redact", PII_REDACT)
def _(spark, d):
    """All detectors, as in the batch form."""
    out = feeds.run_to_table(feeds.stream_redact(_feed(spark, d, "documents"), "doc_id", "text"), "redact")
    return out.select("subject_id", F.md5("redacted_text").alias("redacted_md5"), "total_findings")


@query("stream_ledger", f"{_FOLD} select key, credits, calls as total_calls, epoch_us(created) as created_at, epoch_us(seen) as last_seen from last")
def _(spark, d):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, feeds.ROCKSDB)
    try:
        updates = feeds.run_to_table(feeds.stream_ledger(_chunked_input(spark, d, "ledger_events", late=True), LATENESS), "ledger", "update")
    finally:
        spark.conf.set(setting, before)
    return _stamp(feeds.latest_per_key(updates, "key").drop("open_events"))


@query("stream_dedupe_payments", f"""with {ctes('payment_redemptions')} select signature, count(*) as n from (select distinct signature from payment_redemptions
    where block_time is not null and epoch(attempted_at) - epoch(block_time) <= 86400 and has_meta and wallet_in_tx and lamports >= 100000) group by 1""")
def _(spark, d):
    txs = _chunked_input(spark, d, "payment_redemptions")
    return feeds.run_to_table(feeds.stream_dedupe_payments(txs).select("signature"), "dedupe").groupBy("signature").agg(F.count(F.lit(1)).alias("n"))


_HOLIDAYS = """nth as (select y, make_date(y, m, 1) + cast((dow - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1) as int) as d, name from range(2020, 2036) t(y),
      (values (1, 1, 3, 'Martin Luther King Jr. Day'), (2, 1, 3, 'Presidents'' Day'), (9, 1, 1, 'Labor Day'), (10, 1, 2, 'Columbus Day'), (11, 4, 4, 'Thanksgiving Day')) v(m, dow, n, name)),
    fixed as (select y, make_date(y, m, dd) as d, name from range(2020, 2036) t(y), (values (1, 1, 'New Year''s Day'), (6, 19, 'Juneteenth National Independence Day'), (7, 4, 'Independence Day'),
      (11, 11, 'Veterans Day'), (12, 25, 'Christmas Day')) v(m, dd, name) where not (m = 6 and y < 2021)),
    may as (select y, make_date(y, 5, 31) - cast((isodow(make_date(y, 5, 31)) - 1) as int) as d, 'Memorial Day' as name from range(2020, 2036) t(y)),
    hol as (select name, d as date from nth union all select name, case isodow(d) when 6 then d - 1 when 7 then d + 1 else d end from fixed union all select name, d from may)"""


@query("orders_on_holidays", f"with {_HOLIDAYS} select name, count(*) as orders from orders join hol on cast(o_orderdate + interval 28 years as date) = hol.date group by name")
def _(spark, d):
    """Reference holidays joined to order dates moved into their years."""
    days = table(spark, d, "orders").select(F.to_date(F.expr("o_orderdate + interval 28 years")).alias("date"))
    return days.join(reference.holidays(spark), "date").groupBy("name").agg(F.count(F.lit(1)).alias("orders"))
