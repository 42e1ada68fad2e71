"""Queries over names, prescriptions, market snapshots and portfolios."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gatehouse.operators import findings, market, rx, screening
from gatehouse.plans.inputs import ctes, table
from gatehouse.plans.inputs import load
from gatehouse.sources import reference
from gatehouse.streaming import feeds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2024-01-30 12:00:00"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# Names -----------------------------------------------------------------------------------------------
def _records(spark, d):
    return load(spark, d, "listed").select("record_id", "name", F.array("alias").alias("aliases"), "program", "entity_type", "list")


_NORM = "trim(regexp_replace(upper(strip_accents({c})), '[^A-Z0-9]+', ' ', 'g'))"
_SUFFIX = "('LLC','LTD','LIMITED','INC','INCORPORATED','CO','CORP','CORPORATION','COMPANY','PLC','GMBH','AG','SA','SAS','SL','LP','LLP','PJSC','OJSC','OAO','JSC','ZAO','PT','BV','NV','SPA','SRL','PTE','PVT')"
_KEY = ("array_to_string(list_sort(case when len(list_filter(string_split({n}, ' '), lambda w: w not in " + _SUFFIX + ")) > 0 then "
        "list_filter(string_split({n}, ' '), lambda w: w not in " + _SUFFIX + ") else string_split({n}, ' ') end), ' ')")
_NAMES = f"""{ctes('listed', 'queried')}, q as (select name_id, name, {_NORM.format(c='name')} as norm from queried),
    l as (select record_id, name as listed_name, 0 as pos, {_NORM.format(c='name')} as norm from listed union all select record_id, name, 1, {_NORM.format(c='alias')} from listed),
    ex as (select name_id, record_id, min(pos) as pos from q join l using (norm) where norm <> '' group by all)"""


@query("normalize_names", f"with {_NAMES} select name_id, norm, {_KEY.format(n='norm')} as sort_key from q")
def _(spark, d):
    return screening.normalize_names(load(spark, d, "queried")).select("name_id", "norm", "sort_key")


@query("exact_matches", f"with {_NAMES} select name_id, record_id, 1.0 as score, case pos when 0 then 'exact' else 'alias' end as match_type from ex")
def _(spark, d):
    return screening.screen_matches(load(spark, d, "queried"), _records(spark, d), fuzzy=False).select("name_id", "record_id", "score", "match_type")


# The SQL engine's own Jaro-Winkler rounds half transpositions down, so it never scores lower than the exact
# value: it preselects pairs without loss, and the exact value is then folded character by character.
_FUZZY = f"""qk as (select distinct norm, {_KEY.format(n='norm')} as a from q where norm <> ''), lk as (select record_id, pos, {_KEY.format(n='norm')} as b from l where norm <> ''),
    near as (select distinct a, b from (select distinct a from qk) x, (select distinct b from lk) y where jaro_winkler_similarity(a, b) >= 0.849999),
    fold as (select a, b, list_reduce(list_transform(range(1, length(a) + 1), lambda i: {{'i': i, 'b': '', 'm': ''}}), lambda acc, x:
        case when instr(acc.b[greatest(1, x.i - reach):least(x.i + reach, length(b))], a[x.i]) > 0
             then {{'i': x.i, 'b': acc.b[1:greatest(1, x.i - reach) + instr(acc.b[greatest(1, x.i - reach):least(x.i + reach, length(b))], a[x.i]) - 2] || chr(1)
                   || acc.b[greatest(1, x.i - reach) + instr(acc.b[greatest(1, x.i - reach):least(x.i + reach, length(b))], a[x.i]):], 'm': acc.m || a[x.i]}}
             else acc end, {{'i': 0::bigint, 'b': b, 'm': ''}}) as f from (select *, greatest(0, greatest(length(a), length(b)) // 2 - 1) as reach from near)),
    moved as (select a, b, length(f.m) as m, len(list_filter(range(1, length(f.m) + 1), lambda k: f.m[k] <> array_to_string(list_transform(range(1, length(b) + 1), lambda j: case when f.b[j] = chr(1) then b[j] else '' end), '')[k])) as t from fold),
    jw as (select a, b, case when a = b then 1.0 else j + p * 0.1 * (1 - j) end as s from (select a, b, (m / length(a) + m / length(b) + (m - t / 2) / m) / 3 as j,
        case when a[1] <> b[1] then 0 when a[1:2] <> b[1:2] or least(length(a), length(b)) < 2 then 1 when a[1:3] <> b[1:3] or least(length(a), length(b)) < 3 then 2
             when a[1:4] <> b[1:4] or least(length(a), length(b)) < 4 then 3 else 4 end as p from moved where m > 0)),
    fz as (select name_id, record_id, max(s) as s from q join qk using (norm) join jw using (a) join lk using (b) where s >= 0.85 and not exists (select 1 from ex where ex.name_id = q.name_id and ex.record_id = lk.record_id) group by all)"""


@query("fuzzy_matches", f"with {_NAMES}, {_FUZZY} select name_id, record_id, round(s, 4) as score from fz")
def _(spark, d):
    names, records = load(spark, d, "queried"), _records(spark, d)
    # Only what is asked for is paired with the bearers of a name.
    fuzzy = screening.distinct_matches(names, records).where("match_type = 'fuzzy'").select("norm", "record_id", "score")
    return screening.bearers(names, fuzzy, ["norm"], records).select("name_id", "record_id", "score")


@query("screen_names", f"""with {_NAMES}, {_FUZZY}, m as (select name_id, round(s, 4) as s from fz union all select name_id, 1.0 from ex), g as (select name_id, count(*) as n, count(*) filter (s >= 0.92) as b from m group by name_id)
    select name_id, case when b > 0 then 'BLOCK' when n > 0 then 'FLAG' else 'PASS' end as verdict, coalesce(n, 0) as total, coalesce(b, 0) as block, coalesce(n - b, 0) as flag from queried left join g using (name_id)""")
def _(spark, d):
    return screening.screen_names(load(spark, d, "queried"), _records(spark, d)).drop("best_score")


@query("screen_names_exact_individuals", f"""with {_NAMES}, e as (select name_id, count(*) as n from ex join listed using (record_id) where entity_type = 'individual' group by name_id)
    select name_id, case when n > 0 then 'BLOCK' else 'PASS' end as verdict, coalesce(n, 0) as total, coalesce(n, 0) as block, 0 as flag from queried left join e using (name_id)""")
def _(spark, d):
    return screening.screen_names(load(spark, d, "queried"), _records(spark, d), entity_types=["individual"], fuzzy=False).drop("best_score")


@query("stream_screen", f"""with {_NAMES}, {_FUZZY} select name_id, record_id, case pos when 0 then 'exact' else 'alias' end as match_type, 1.0 as score from ex
    union all select name_id, record_id, 'fuzzy', round(s, 4) from fz""")
def _(spark, d):
    """The batch screening run per micro-batch over a stream of customers."""
    from gatehouse.plans.inputs import INPUTS
    path = os.path.join(d, "custome[r].parquet")
    feed = feeds.stream_request_feed(spark, path, table(spark, d, "customer").schema)
    folder = feeds.work_folder(spark, "screen")
    records = _records(spark, d)
    feeds.stream_screen(spark.sql(INPUTS["queried"], customer=feed), records, folder + "/out", folder + "/mark").awaitTermination()
    return feeds.screened(spark, folder + "/out", records).select("name_id", "record_id", "match_type", "score")


# Prescriptions ---------------------------------------------------------------------------------------
_MED_LINES = [line.split("|") for line in reference.MEDICATIONS.strip().split("\n")]
_PAIR_LINES = [line.split("|") for line in reference.INTERACTIONS.strip().split("\n")]
_MEDS = ("meds(no, generic, brand, dim, unit_c, top, per_kg) as (values " + ", ".join(
    f"({i}, '{g}', '{(b.split(',')[0] or g)}', '{dim}', '{u}', {top or 'null::double'}, {kg or 'null::double'})" for i, (g, b, dim, u, top, kg) in enumerate(_MED_LINES)) + ")")
_PAIRS = "pairs(a, b, severity) as (values " + ", ".join(f"('{a}', '{b}', '{s}')" for a, b, s in _PAIR_LINES) + ")"
_RX = f"""{_MEDS}, {_PAIRS}, {ctes('rx', 'patients')},
    named as (select patient_id, pos, dose, unit, freq, case when drug_no < 82 then generic else 'drug ' || drug_no end as generic, drug_no < 82 as known, dim, unit_c, top, per_kg from rx left join meds on no = drug_no),
    u as (select *, case when lower(unit) = unit_c or not known then null when (unit_c = 'mcg' and lower(unit) = 'mg') or (unit_c = 'mg' and lower(unit) = 'mcg') then 'magnitude error of 1000'
        when dim = 'mass' then 'not the canonical unit' else 'wrong dimension' end as issue from named)"""


def _rx(spark, d):
    """Brand names in upper case for even positions, so that resolution has work to do."""
    meds = reference.medications(spark).select(F.col("med_pos").alias("drug_no"), "generic", F.coalesce(F.get("brands", F.lit(0)), "generic").alias("brand"))
    named = load(spark, d, "rx").join(F.broadcast(meds), "drug_no", "left")
    name = F.when(F.col("generic").isNull(), F.concat(F.lit(" Drug "), "drug_no")).when(F.col("pos") % 2 == 0, F.upper("brand")).otherwise(F.col("generic"))
    return named.withColumn("name", name).select("patient_id", "pos", "name", "dose", "unit", "freq")


@query("resolve_drugs", f"with {_RX} select patient_id, pos, generic, known from named")
def _(spark, d):
    return rx.resolve_drugs(_rx(spark, d), reference.medications(spark)).select("patient_id", "pos", "generic", "known")


@query("unit_findings", f"with {_RX} select patient_id, pos, 'unit' as kind, 'major' as severity, generic as drug, issue as message from u where issue is not null")
def _(spark, d):
    return rx.unit_findings(_rx(spark, d), reference.medications(spark)).drop("other_drug")


_DOSE = """dose as (select patient_id, pos, case when dose * freq >= 2 * top then 'contraindicated' else 'major' end as severity, generic as drug from u where known and issue is null and dose * freq > top
    union all select u.patient_id, pos, 'major', generic from u join patients p on p.patient_id = u.patient_id where known and issue is null and dose * freq > per_kg * weight_kg)"""


@query("dose_findings", f"with {_RX}, {_DOSE} select * from dose")
def _(spark, d):
    return rx.dose_findings(_rx(spark, d), reference.medications(spark), load(spark, d, "patients")).select("patient_id", "pos", "severity", "drug")


_INTER = """pk as (select least(a, b) as a, greatest(a, b) as b, max(case severity when 'contraindicated' then 3 when 'major' then 2 else 1 end) as r from pairs group by all),
    inter as (select x.patient_id, x.pos, x.generic as drug, y.generic as other_drug, case r when 3 then 'contraindicated' when 2 then 'major' else 'moderate' end as severity
      from named x join named y on x.patient_id = y.patient_id and x.pos < y.pos join pk on pk.a = least(x.generic, y.generic) and pk.b = greatest(x.generic, y.generic))"""


@query("interaction_pairs", f"with {_RX}, {_INTER} select patient_id, pos, drug, other_drug, severity from inter")
def _(spark, d):
    return rx.interaction_pairs(_rx(spark, d), reference.medications(spark), reference.interactions(spark)).select("patient_id", "pos", "drug", "other_drug", "severity")


@query("rx_verdicts", f"""with {_RX}, {_DOSE}, {_INTER}, f as (select patient_id, 0 as s from named where not known union all select patient_id, 2 from u where issue is not null
      union all select patient_id, case severity when 'contraindicated' then 3 else 2 end from dose union all select patient_id, case severity when 'contraindicated' then 3 when 'major' then 2 else 1 end from inter),
    g as (select patient_id, max(s) as w, count(*) as n, count(*) filter (s = 0) as n_low, count(*) filter (s = 1) as n_moderate, count(*) filter (s = 2) as n_major, count(*) filter (s = 3) as n_contraindicated from f group by patient_id)
    select p.patient_id, case when n is null then 'PASS' when w >= 2 then 'BLOCK' else 'FLAG' end as verdict, coalesce(n, 0) as total_findings, coalesce(n_low, 0) as n_low, coalesce(n_moderate, 0) as n_moderate,
    coalesce(n_major, 0) as n_major, coalesce(n_contraindicated, 0) as n_contraindicated from patients p left join g using (patient_id)""")
def _(spark, d):
    return rx.rx_check(_rx(spark, d), reference.medications(spark), reference.interactions(spark), load(spark, d, "patients"))


# Market ----------------------------------------------------------------------------------------------
@query("unit_scale_check", f"""with {ctes('transfers', 'decimals')}, j as (select t.*, decimals, cast(floor(ui_amount * power(10, decimals) + 0.5) as hugeint) as expected, try_cast(raw_amount as hugeint) as actual from transfers t left join decimals using (token)),
    v as (select *, case when actual = 0 then (case when expected = 0 then 0.0 end) else abs(expected - actual) / abs(actual) * 100 end as dev from j)
    select transfer_id, case when decimals is null then 'FLAG' when actual is null or (actual = 0 and expected <> 0) or dev > 1 then 'BLOCK' when dev > 0.1 then 'FLAG' else 'PASS' end as verdict,
    case when decimals is null then 50.0 when actual is null or (actual = 0 and expected <> 0) or dev > 1 then 100.0 when dev > 0.1 then 40.0 else 0.0 end as score,
    case when decimals is not null then round(dev, 6) end as deviation_pct from v""")
def _(spark, d):
    out = market.unit_scale_check(load(spark, d, "transfers"), load(spark, d, "decimals"))
    return out.select("transfer_id", "verdict", "score", F.round("deviation_pct", 6).alias("deviation_pct"))


_QUOTES = f"""latest as (select symbol, source, arg_max(price, (updated_at, price)) as price, max(updated_at) as updated_at from quotes_m where updated_at <= timestamp '{AS_OF}' group by all),
    agreed as (select symbol, count(*) as n, avg(price) as c, min(price) as lo, max(price) as hi, max(floor(epoch(timestamp '{AS_OF}')) - floor(epoch(updated_at))) as age from latest group by symbol)"""


@query("latest_quotes", f"with {ctes('quotes_m')}, {_QUOTES} select symbol, source, price from latest")
def _(spark, d):
    return market.latest_quotes(load(spark, d, "quotes_m"), AS_OF).select("symbol", "source", "price")


@query("price_consensus", f"""with {ctes('quotes_m', 'proposals')}, {_QUOTES}, j as (select p.*, coalesce(n, 0) as n, c, case when lo = 0 then 'inf'::double else (hi - lo) / lo * 100 end as apart,
      age > case asset_type when 'stock' then 36000 else 60 end as stale, abs(proposed_price - c) / c * 100 as dev from proposals p left join agreed using (symbol)),
    s as (select *, greatest(case when n = 0 then 100 else 0 end, case when n = 1 then 40 else 0 end, case when stale then 90 else 0 end, case when n >= 2 and apart > 20 then 85 else 0 end, case when dev > 5 then 95 when dev > 2 then 50 else 0 end) as score from j)
    select proposal_id, n as sources, round(c, 6) as consensus_price, round(dev, 6) as deviation_pct, cast(score as double) as score, case when score >= 85 then 'BLOCK' when score > 0 then 'FLAG' else 'PASS' end as verdict from s""")
def _(spark, d):
    out = market.price_consensus(load(spark, d, "proposals"), load(spark, d, "quotes_m"), AS_OF, divergence_pct=20, max_age={"crypto": 60, "stock": 36000})
    return out.select("proposal_id", "sources", F.round("consensus_price", 6).alias("consensus_price"), F.round("deviation_pct", 6).alias("deviation_pct"), "score", "verdict")


@query("price_consensus_at", f"""with {ctes('quotes_m', 'timed_proposals')}, one as (select symbol, source, updated_at, max(price) as price from quotes_m group by all),
    t as (select p.*, s.source from timed_proposals p join (select distinct symbol, source from one) s using (symbol)),
    k as (select t.proposal_id, q.price, floor(epoch(t.at)) - floor(epoch(q.updated_at)) as age from t asof join one q on t.symbol = q.symbol and t.source = q.source and t.at >= q.updated_at),
    agreed as (select proposal_id, count(*) as n, avg(price) as c, min(price) as lo, max(price) as hi, max(age) as age from k group by 1),
    j as (select p.*, coalesce(n, 0) as n, c, case when lo = 0 then 'inf'::double else (hi - lo) / lo * 100 end as apart, age > case asset_type when 'stock' then 36000 else 7200 end as stale, abs(proposed_price - c) / c * 100 as dev
          from timed_proposals p left join agreed using (proposal_id)),
    s as (select *, greatest(case when n = 0 then 100 else 0 end, case when n = 1 then 40 else 0 end, case when stale then 90 else 0 end, case when n >= 2 and apart > 20 then 85 else 0 end, case when dev > 5 then 95 when dev > 2 then 50 else 0 end) as score from j)
    select proposal_id, n as sources, round(c, 6) as consensus_price, round(dev, 6) as deviation_pct, cast(score as double) as score, case when score >= 85 then 'BLOCK' when score > 0 then 'FLAG' else 'PASS' end as verdict from s""")
def _(spark, d):
    """Each proposal against the prices known at its own time."""
    out = market.price_consensus_at(load(spark, d, "timed_proposals"), load(spark, d, "quotes_m"), divergence_pct=20, max_age={"crypto": 7200, "stock": 36000})
    return out.select("proposal_id", "sources", F.round("consensus_price", 6).alias("consensus_price"), F.round("deviation_pct", 6).alias("deviation_pct"), "score", "verdict")


_BEST = "best as (select * from (select *, row_number() over (partition by token order by liquidity desc, pair_pos) as r from pools) where r = 1)"


@query("best_pairs", f"with {ctes('pools')}, {_BEST} select token, pair_pos, liquidity from best")
def _(spark, d):
    return market.best_pairs(load(spark, d, "pools")).select("token", "pair_pos", "liquidity")


_LIQ = """lj as (select t.*, liquidity, volume24h, trade_usd / liquidity * 200 as impact from trades t left join best using (token)),
    liq as (select trade_id, impact, case when coalesce(liquidity, 0) <= 0 then 100 else greatest(case when liquidity < 10000 then 90 when liquidity < 20000 then 45 else 0 end, case when impact > 2 then 85 when impact > 1 then 40 else 0 end,
      case when volume24h / liquidity > 10 then 50 else 0 end) end as score from lj)"""


@query("liquidity_check", f"""with {ctes('trades', 'pools')}, {_BEST}, {_LIQ} select trade_id, round(impact, 6) as impact_pct, cast(score as double) as score, case when score >= 85 then 'BLOCK' when score > 0 then 'FLAG' else 'PASS' end as verdict from liq""")
def _(spark, d):
    return market.liquidity_check(load(spark, d, "trades"), load(spark, d, "pools")).select("trade_id", F.round("impact_pct", 6).alias("impact_pct"), "score", "verdict")


def _rug(spark, d):
    risk = F.when(F.col("score") > 70, F.array(F.struct(F.lit("Copycat").alias("name"), F.lit("danger").alias("level")), F.struct(F.lit("Low holders").alias("name"), F.lit("warn").alias("level"))))
    return load(spark, d, "rug").withColumn("risks", F.coalesce(risk, F.array().cast("array<struct<name:string,level:string>>")))


_TOKEN = """tr as (select t.token, t.chain, r.token is null as missing, r.score as s, greatest(case when chain <> 'solana' or r.token is null then 50 else 0 end, case when chain = 'solana' and mint_active then 90 else 0 end, case when chain = 'solana' and freeze_active then 90 else 0 end,
      case when chain = 'solana' and r.score > 60 then least(100, r.score) when chain = 'solana' and r.score >= 40 then r.score else 0 end, case when chain = 'solana' and lp_locked_pct = 0 then 45 else 0 end) as score,
      chain = 'solana' and (coalesce(mint_active, false) or coalesce(freeze_active, false) or coalesce(r.score > 60, false)) as blocked from tokens t left join rug r on r.token = t.token)"""


@query("token_risk", f"""with {ctes('tokens', 'rug')}, {_TOKEN} select token, chain, cast(score as double) as score, case when blocked then 'BLOCK' when score > 0 then 'FLAG' else 'PASS' end as verdict,
    case when chain = 'solana' and not missing then case when s > 70 then 'Copycat:critical,Low holders:warn' else '' end end as listed_risks from tr""")
def _(spark, d):
    return market.token_risk(load(spark, d, "tokens"), _rug(spark, d)).select("token", "chain", "score", "verdict", "listed_risks")


_PORT = """held as (select account, sum(value_usd) as held, count(distinct symbol) as open_positions from positions group by account), day as (select account, sum(pnl_usd) as daily from pnl group by account),
    port as (select account, coalesce(held, 0) + cash_usd as total, cash_usd, daily, coalesce(open_positions, 0) as open_positions from cash left join held using (account) left join day using (account))"""


def _portfolio(spark, d):
    return market.portfolio_snapshot(load(spark, d, "positions"), load(spark, d, "cash"), load(spark, d, "pnl"))


@query("portfolio_snapshot", f"with {ctes('positions', 'cash', 'pnl')}, {_PORT} select account, round(total, 2) as total_value_usd, cash_usd, round(daily, 2) as daily_pnl_usd, open_positions from port")
def _(spark, d):
    return _portfolio(spark, d).select("account", F.round("total_value_usd", 2).alias("total_value_usd"), "cash_usd", F.round("daily_pnl_usd", 2).alias("daily_pnl_usd"), "open_positions")


@query("position_limits", f"""with {ctes('trades', 'positions', 'cash', 'pnl', 'rules')}, {_PORT}, j as (select t.*, p.*, r.*, trade_usd * leverage as eff from trades t left join port p using (account) left join rules r using (account)),
    v as (select trade_id, concat_ws(',', case when kill_switch then 'kill_switch' end, case when total > 0 and -daily / total * 100 > 10 then 'max_daily_loss' end, case when eff > max_single_trade_usd then 'max_single_trade_usd' end,
      case when leverage > 3 then 'max_leverage' end, case when total > 0 and eff / total * 100 > max_position_pct then 'max_position_pct' end, case when open_positions >= 10 then 'max_open_positions' end) as violations from j)
    select trade_id, violations, case when violations = '' then 'PASS' else 'BLOCK' end as verdict from v""")
def _(spark, d):
    return market.position_limits(load(spark, d, "trades"), _portfolio(spark, d), load(spark, d, "rules")).select("trade_id", "violations", "verdict")


@query("resolve_symbols", f"""with {ctes('symbol_queries', 'pools_1', 'coins')}, c as (select query_id, name from symbol_queries q join pools_1 p on lower(p.symbol) = lower(q.symbol) where chain is null or chain = chain_id
      union all select query_id, name from symbol_queries q join coins c on lower(c.symbol) = lower(q.symbol)),
    g as (select query_id, count(*) as n, bool_or(expected_name is null or contains(lower(name), lower(expected_name)) or contains(lower(expected_name), lower(name))) as named from c join symbol_queries using (query_id) group by query_id)
    select query_id, coalesce(n, 0) as matches, case when n is null then 'BLOCK' when not named or n > 1 then 'FLAG' else 'PASS' end as verdict from symbol_queries left join g using (query_id)""")
def _(spark, d):
    return market.resolve_symbols(load(spark, d, "symbol_queries"), load(spark, d, "pools_1"), load(spark, d, "coins")).select("query_id", "matches", "verdict")


def _orders(spark, d):
    return load(spark, d, "trades").select(
        F.col("trade_id").alias("order_id"), "symbol", F.when(F.col("trade_id") % 4 != 0, F.col("token")).alias("token"), F.lit("solana").alias("chain"), F.lit("crypto").alias("asset_type"), "trade_usd", "leverage",
        F.when(F.col("trade_id") % 3 != 0, F.col("trade_usd") * (F.col("trade_id") % 20)).alias("portfolio_value_usd"))


_ORDER = f"""{_BEST}, {_LIQ}, {_QUOTES}, {_TOKEN.replace('t.chain, r', "'solana' as chain, r").replace('from tokens t left', "from (select distinct token, 'solana' as chain from trades) t left")},
    gates as (select trade_id as id, 0 as o, 'rug' as gate, tr.score as score, case when blocked then 2 when tr.score > 0 then 1 else 0 end as r from trades join tr using (token) where trade_id % 4 <> 0
      union all select trade_id, 1, 'liquidity', score, case when score >= 85 then 2 when score > 0 then 1 else 0 end from liq where trade_id % 4 <> 0
      union all select trade_id, 2, 'price', s, case when s >= 85 then 2 when s > 0 then 1 else 0 end from (select trade_id, greatest(case when n is null then 100 when n = 1 then 40 else 0 end, case when age > 60 then 90 else 0 end, case when n >= 2 and (hi - lo) / lo * 100 > 2 then 85 else 0 end) as s from trades left join agreed using (symbol))
      union all select trade_id, 3, 'position', case when b then 100 else 0 end, case when b then 2 else 0 end from (select trade_id, leverage > 3 or (trade_usd * (trade_id % 20) > 0 and trade_usd * leverage / nullif(trade_usd * (trade_id % 20), 0) * 100 > 25) as b from trades where trade_id % 3 <> 0))"""


@query("order_risk", f"""with {ctes('trades', 'pools', 'quotes_m', 'rug')}, {_ORDER} select id as subject_id, case max(r) when 2 then 'BLOCK' when 1 then 'FLAG' else 'PASS' end as verdict, cast(max(score) as double) as score,
    arg_min(gate, o) filter (r = 2) as blocked_by, count(*) as gates_run from gates group by id""")
def _(spark, d):
    return market.order_risk(_orders(spark, d), _rug(spark, d), load(spark, d, "pools"), load(spark, d, "quotes_m"), AS_OF)


@query("compose_gates", f"""with {ctes('trades', 'pools', 'positions', 'cash', 'pnl')}, {_BEST}, {_LIQ}, {_PORT},
    g as (select trade_id, 0 as o, 'liquidity' as gate, score, case when score >= 85 then 2 when score > 0 then 1 else 0 end as r from liq
      union all select trade_id, 1, 'position', case when b then 100 else 0 end, case when b then 2 else 0 end from (select trade_id, leverage > 3 or (total > 0 and -daily / total * 100 > 10) or (total > 0 and trade_usd * leverage / total * 100 > 25) or open_positions >= 10 as b from trades left join port using (account)))
    select trade_id as subject_id, case max(r) when 2 then 'BLOCK' when 1 then 'FLAG' else 'PASS' end as verdict, cast(max(score) as double) as score, arg_min(gate, o) filter (r = 2) as blocked_by, count(*) as gates_run from g group by trade_id""")
def _(spark, d):
    shape = lambda df: df.select(F.col("trade_id").alias("subject_id"), "verdict", "score")
    trades = load(spark, d, "trades")
    return findings.compose_gates([("liquidity", shape(market.liquidity_check(trades, load(spark, d, "pools")))), ("position", shape(market.position_limits(trades, _portfolio(spark, d))))])
