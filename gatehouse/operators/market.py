"""Market and portfolio checks over snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatehouse.functions.bind import let
from gatehouse.operators.findings import verdict_name

_RISK = "struct<type:string,severity:string,verdict:int,score:double>"


def _risk(when: Column, kind: str, severity: str, verdict: int, score: float | Column) -> Column:
    score = score if isinstance(score, Column) else F.lit(score)
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(verdict).alias("verdict"),
                                 score.cast("double").alias("score"))).cast(_RISK)


def _outcome(risks: list[Column]) -> Column:
    """``struct(rank, score)`` of the risks that apply, inside a row."""
    return let(F.filter(F.array(*risks), lambda r: r.isNotNull()), lambda hit: F.struct(
        F.coalesce(F.array_max(F.transform(hit, lambda r: r["verdict"])), F.lit(0)).alias("rank"),
        F.coalesce(F.array_max(F.transform(hit, lambda r: r["score"])), F.lit(0.0)).alias("score")))


def _judge(df: DataFrame, keep: list, risks: list[Column]) -> DataFrame:
    """Highest verdict and score of the risks that apply; their names in rule order."""
    hit = F.filter(F.array(*risks), lambda r: r.isNotNull())
    return df.withColumn("_r", hit).select(
        *keep, verdict_name(F.coalesce(F.array_max(F.transform("_r", lambda r: r["verdict"])), F.lit(0))).alias("verdict"),
        F.coalesce(F.array_max(F.transform("_r", lambda r: r["score"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("_r", lambda r: r["type"]), ",").alias("risks"))


def unit_scale_check(transfers: DataFrame, tokens: DataFrame) -> DataFrame:
    """``transfers``: ``transfer_id, token, raw_amount string, ui_amount double``; ``tokens``: ``token, decimals``."""
    joined = transfers.join(tokens.select("token", "decimals"), "token", "left")
    expected = F.floor(F.col("ui_amount") * F.pow(F.lit(10.0), F.col("decimals")) + 0.5).try_cast("decimal(38,0)")
    actual = F.when(F.trim("raw_amount").rlike("^[+-]?[0-9]+$"), F.trim("raw_amount").try_cast("decimal(38,0)"))
    gap = F.abs(F.col("expected") - F.col("actual")).cast("double")
    sized = joined.withColumn("expected", expected).withColumn("actual", actual).withColumn(
        "deviation_pct", F.when(F.col("actual") == 0, F.when(F.col("expected") == 0, 0.0))
        .otherwise(gap / F.abs(F.col("actual")).cast("double") * 100))
    known = F.col("decimals").isNotNull()
    infinite = (F.col("actual") == 0) & (F.col("expected") != 0)
    return _judge(sized, ["transfer_id", "token", "decimals", "deviation_pct"], [
        _risk(~known, "decimals_unavailable", "warn", 1, 50),
        _risk(known & F.col("actual").isNull(), "invalid_raw_amount", "critical", 2, 100),
        _risk(known & (infinite | (F.col("deviation_pct") > 1)), "decimal_scaling_error", "critical", 2, 100),
        _risk(known & (F.col("deviation_pct") > 0.1) & (F.col("deviation_pct") <= 1), "decimal_rounding", "warn", 1, 40),
    ])


def latest_quotes(quotes: DataFrame, as_of: str) -> DataFrame:
    """Last quote per symbol and source not after ``as_of``; ``max_by`` combines before the shuffle."""
    return quotes.where(F.col("updated_at") <= F.lit(as_of).cast("timestamp")).groupBy("symbol", "source").agg(
        F.max(F.struct("updated_at", "price")).alias("q")).select("symbol", "source", "q.*")


def price_consensus(proposals: DataFrame, quotes: DataFrame, as_of: str, divergence_pct: float = 2.0,
                    max_age: dict[str, int] | None = None) -> DataFrame:
    """``proposals``: ``proposal_id, symbol, asset_type, proposed_price``; ``quotes``: ``symbol, source, price, updated_at``
    (a NULL time means the price has no age)."""
    return _judge_proposals(proposals.join(_agreed_prices(quotes, as_of), "symbol", "left"), [], divergence_pct, max_age)


def _judge_proposals(joined: DataFrame, keep: list[str], divergence_pct: float, max_age: dict[str, int] | None) -> DataFrame:
    joined = joined.withColumn("n", F.coalesce("sources", F.lit(0)))
    off = F.when(F.col("consensus_price") == 0, F.lit(float("inf"))).otherwise(
        F.abs(F.col("proposed_price") - F.col("consensus_price")) / F.col("consensus_price") * 100)
    ready = joined.withColumn("deviation_pct", F.when(F.col("proposed_price").isNotNull(), off))
    return _judge(ready, ["proposal_id", "symbol", *keep, F.col("n").alias("sources"), "consensus_price", "deviation_pct"],
                  _price_risks(F.col, F.col("asset_type"), F.col("deviation_pct"), divergence_pct, max_age))


def quotes_at(asked: DataFrame, quotes: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """As-of join: for each row of ``asked`` (``symbol, at``) and each source of its symbol the last quote not after ``at``: ``symbol, at, source, price, updated_at``.

    Both sides are one table in the order of time, in which the last quote is carried forward.  Time is cut into buckets, so that a symbol with very many rows is
    many tasks; what a bucket begins with comes from a table of one row per bucket.  Of quotes at one time the highest price counts.
    """
    slot = lambda t: F.unix_seconds(F.window(t, bucket)["start"])
    keys = ["symbol", "source"]
    last = quotes.where("updated_at is not null").groupBy(*keys, "updated_at").agg(F.max("price").alias("price")).withColumn("slot", slot(F.col("updated_at")))
    quote = F.struct("updated_at", "price")
    ends = last.groupBy(*keys, "slot").agg(F.max(quote).alias("quote"))
    questions = asked.select("symbol", "at").where("at is not null").distinct().withColumn("slot", slot(F.col("at")))
    sources = ends.select(*keys).distinct()
    # One row for each bucket that has quotes or questions: the last quote of an earlier bucket.
    slots = questions.select("symbol", "slot").distinct().join(sources, "symbol").select(*keys, "slot", F.lit(None).cast(ends.schema["quote"].dataType).alias("quote"))
    order = Window.partitionBy(*keys).orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
    begun = ends.unionByName(slots).withColumn("before", F.last("quote", ignorenulls=True).over(order)).groupBy(*keys, "slot").agg(F.max("before").alias("before"))
    # Questions come after the quotes of their time.
    rows = last.select(*keys, "slot", F.col("updated_at").alias("at"), F.lit(0).alias("asks"), quote.alias("quote")).unionByName(
        questions.join(sources, "symbol").select(*keys, "slot", "at", F.lit(1).alias("asks"), F.lit(None).cast(ends.schema["quote"].dataType).alias("quote")))
    # By a number of tasks: buckets compress well, and partitions joined by their bytes would hold very many rows.
    rows = rows.repartition(int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "slot")
    inside = Window.partitionBy(*keys, "slot").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("seen", F.last("quote", ignorenulls=True).over(inside)).where("asks = 1")
    found = seen.join(begun, [*keys, "slot"], "left").withColumn("q", F.coalesce("seen", "before")).where("q is not null")
    return found.select("symbol", "at", "source", "q.price", "q.updated_at")


def price_consensus_at(proposals: DataFrame, quotes: DataFrame, divergence_pct: float = 2.0, max_age: dict[str, int] | None = None, bucket: str = "1 hour") -> DataFrame:
    """As :func:`price_consensus`, each proposal judged by the quotes known at its own time ``at``; without a time by those without one only."""
    timeless = quotes.where("updated_at is null").groupBy("symbol", "source").agg(F.max("price").alias("price")).where("price is not null")
    asked = proposals.select("symbol", "at").distinct()
    current = quotes_at(asked, quotes, bucket).where("price is not null").select("symbol", "at", "price", F.greatest(F.lit(0), F.unix_timestamp("at") - F.unix_timestamp("updated_at")).alias("age"))
    current = current.unionByName(asked.join(timeless, "symbol").select("symbol", "at", "price", F.lit(None).cast("long").alias("age")))
    agreed = current.groupBy(F.col("symbol").alias("_s"), F.col("at").alias("_t")).agg(
        F.count(F.lit(1)).alias("sources"), F.avg("price").alias("consensus_price"), F.min("price").alias("low"), F.max("price").alias("high"), F.max("age").alias("oldest_s"))
    joined = proposals.join(agreed, (F.col("symbol") == F.col("_s")) & F.col("at").eqNullSafe(F.col("_t")), "left")
    return _judge_proposals(joined, ["at"], divergence_pct, max_age)


def _agreed_prices(quotes: DataFrame, as_of: str) -> DataFrame:
    """One row per symbol."""
    timeless = quotes.where("updated_at is null").groupBy("symbol", "source").agg(F.max("price").alias("price")).select(
        "symbol", "source", F.lit(None).cast("timestamp").alias("updated_at"), "price")
    current = latest_quotes(quotes, as_of).unionByName(timeless).where("price is not null")
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at"))
    return current.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sources"), F.avg("price").alias("consensus_price"), F.min("price").alias("low"),
        F.max("price").alias("high"), F.max(age).alias("oldest_s"))


def _price_risks(c, asset_type: Column, deviation: Column, divergence_pct: float = 2.0, max_age: dict[str, int] | None = None) -> list[Column]:
    """``c`` gives a column of the agreed price by its name."""
    limits = max_age or {"crypto": 60, "stock": 3600}
    n = F.coalesce(c("sources"), F.lit(0))
    apart = F.when(c("low") == 0, F.lit(float("inf"))).otherwise(F.abs(c("high") - c("low")) / c("low") * 100)
    limit = F.when(asset_type == "stock", limits["stock"]).otherwise(limits["crypto"])
    return [
        _risk(n == 0, "no_price_source", "critical", 2, 100),
        _risk(n == 1, "single_price_source", "warn", 1, 40),
        _risk(c("oldest_s") > limit, "stale_price", "critical", 2, 90),
        _risk((n >= 2) & (apart > divergence_pct), "price_divergence", "critical", 2, 85),
        _risk(deviation > 5, "proposed_price_deviation", "critical", 2, 95),
        _risk((deviation > 2) & (deviation <= 5), "proposed_price_deviation", "warn", 1, 50),
    ]


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Deepest pool per token, the earliest on ties; one aggregate, no sort of a token's pools."""
    order = F.struct(F.coalesce("liquidity", F.lit(0.0)).alias("liquidity"), (-F.col("pair_pos")).alias("pos"))
    top = pairs.groupBy("token").agg(F.max_by(F.struct("pair_pos", "liquidity", "volume24h", "price"), order).alias("p"))
    return top.select("token", "p.*")


def liquidity_check(trades: DataFrame, pairs: DataFrame, max_impact_pct: float = 2.0, min_liquidity: float = 10_000.0) -> DataFrame:
    """``trades``: ``trade_id, token, trade_usd``."""
    joined = trades.join(best_pairs(pairs), "token", "left")
    impact = _impact(F.col("trade_usd"), F.col("liquidity"))
    return _judge(joined.withColumn("impact_pct", impact), ["trade_id", "token", F.col("liquidity").alias("pool_liquidity"), "impact_pct"],
                  _liquidity_risks(F.col, F.col("impact_pct"), max_impact_pct, min_liquidity))


def _impact(trade_usd: Column, liquidity: Column) -> Column:
    return F.when(liquidity > 0, trade_usd / liquidity * 200)


def _liquidity_risks(c, impact: Column, max_impact_pct: float = 2.0, min_liquidity: float = 10_000.0) -> list[Column]:
    """``c`` gives a column of the deepest pool by its name."""
    liq = c("liquidity")
    some = F.coalesce(liq > 0, F.lit(False))
    return [
        _risk(~some, "no_liquidity_data", "critical", 2, 100),
        _risk(some & (liq < min_liquidity), "insufficient_liquidity", "critical", 2, 90),
        _risk(some & (liq >= min_liquidity) & (liq < 2 * min_liquidity), "low_liquidity", "warn", 1, 45),
        _risk(impact > max_impact_pct, "high_price_impact", "critical", 2, 85),
        _risk((impact > 1) & (impact <= max_impact_pct), "elevated_price_impact", "warn", 1, 40),
        _risk(some & (c("volume24h") / liq > 10), "wash_trading_suspected", "warn", 1, 50),
    ]


def token_risk(tokens: DataFrame, snapshot: DataFrame, max_score: float = 60, require_lp_locked: bool = True,
               block_mint: bool = True, block_freeze: bool = True) -> DataFrame:
    """``tokens``: ``token, chain``; ``snapshot``: ``token, score, mint_active, freeze_active, lp_locked_pct, risks
    array<struct<name,level>>``.  Listed risks are reported but do not raise the verdict."""
    j = tokens.join(_token_facts(snapshot), "token", "left")
    seen = (F.col("chain") == "solana") & F.coalesce("found", F.lit(False))
    return _judge(j, ["token", "chain", F.when(seen, F.col("rug_score")).alias("rug_score"),
                        F.when(seen, F.array_join(F.transform("listed", lambda r: F.concat(r["name"], F.when(r["level"] == "danger", ":critical").otherwise(":warn"))), ",")).alias("listed_risks")], _token_risks(F.col, F.col("chain"), max_score, require_lp_locked, block_mint, block_freeze))


def _token_facts(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumnRenamed("score", "rug_score").withColumnRenamed("risks", "listed").withColumn("found", F.lit(True))


def _token_risks(c, chain: Column, max_score: float = 60, require_lp_locked: bool = True, block_mint: bool = True, block_freeze: bool = True) -> list[Column]:
    """``c`` gives a column of the token's snapshot by its name."""
    sol = chain == "solana"
    seen = sol & F.coalesce(c("found"), F.lit(False))
    mint = (2, 90) if block_mint else (1, 50)
    freeze = (2, 90) if block_freeze else (1, 50)
    unlocked = (1, 45) if require_lp_locked else (0, 0)
    score = c("rug_score")
    return [
        _risk(~sol, "unsupported_chain", "warn", 1, 50),
        _risk(sol & ~seen, "rugcheck_unavailable", "warn", 1, 50),
        _risk(seen & c("mint_active"), "mint_authority_active", "critical", *mint),
        _risk(seen & c("freeze_active"), "freeze_authority_active", "critical", *freeze),
        _risk(seen & (score > max_score), "high_rug_score", "critical", 2, F.least(F.lit(100), score)),
        _risk(seen & (score <= max_score) & (score >= 40), "elevated_rug_score", "warn", 1, score),
        _risk(seen & (c("lp_locked_pct") == 0), "lp_not_locked", "warn", *unlocked),
    ]


def portfolio_snapshot(positions: DataFrame, cash: DataFrame, pnl: DataFrame) -> DataFrame:
    """``positions``: ``account, symbol, value_usd``; ``cash``: ``account, cash_usd``; ``pnl``: ``account, pnl_usd``.

    Symbols are summed before an account's map is built, so its size is that of the account's symbols.
    """
    per_symbol = positions.groupBy("account", "symbol").agg(F.sum("value_usd").alias("v"))
    held = per_symbol.groupBy("account").agg(
        F.sum("v").alias("held"), F.count(F.lit(1)).alias("open_positions"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "v")))).alias("allocation"))
    day = pnl.groupBy("account").agg(F.sum("pnl_usd").alias("daily_pnl_usd"))
    money = cash.groupBy("account").agg(F.sum("cash_usd").alias("cash_usd"))
    return money.join(held, "account", "left").join(day, "account", "left").select(
        "account", (F.coalesce("held", F.lit(0.0)) + F.col("cash_usd")).alias("total_value_usd"), "cash_usd", "daily_pnl_usd",
        F.coalesce("open_positions", F.lit(0)).alias("open_positions"), "allocation")


def position_limits(trades: DataFrame, portfolios: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``trades``: ``trade_id, account, symbol, trade_usd, leverage``.  ``rules`` is one optional row per account;
    missing limits fall back to 25 % position, 10 % daily loss, 10 open positions and 3x leverage."""
    limits = {"max_position_pct": 25.0, "max_daily_loss_pct": 10.0, "max_open_positions": 10, "max_leverage": 3.0}
    j = trades.join(portfolios, "account", "left")
    extra = {"allowed_assets": "array<string>", "kill_switch": "boolean", "max_single_trade_usd": "double"}
    have = set(rules.columns) if rules is not None else set()
    if rules is not None:
        j = j.join(rules, "account", "left")
    for name, value in limits.items():
        j = j.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value))
    for name, kind in extra.items():
        if name not in have:
            j = j.withColumn(name, F.lit(None).cast(kind))
    lev = F.coalesce("leverage", F.lit(1.0))
    total = F.col("total_value_usd")
    sized = j.withColumn("effective_usd", F.col("trade_usd") * lev).withColumn(
        "position_pct", F.when(total > 0, F.col("effective_usd") / total * 100))
    block = lambda when, kind: _risk(when, kind, "critical", 2, 100)
    return _judge(sized, ["trade_id", "account", "effective_usd", "position_pct"], [
        block(F.col("kill_switch"), "kill_switch"),
        block((total > 0) & (-F.col("daily_pnl_usd") / F.when(total > 0, total) * 100 > F.col("max_daily_loss_pct")), "max_daily_loss"),
        block(~F.array_contains("allowed_assets", F.col("symbol")), "asset_not_allowed"),
        block(F.col("effective_usd") > F.col("max_single_trade_usd"), "max_single_trade_usd"),
        block(lev > F.col("max_leverage"), "max_leverage"),
        block(F.col("position_pct") > F.col("max_position_pct"), "max_position_pct"),
        block(F.col("open_positions") >= F.col("max_open_positions"), "max_open_positions"),
    ]).withColumnRenamed("risks", "violations")


def _candidates(dex: DataFrame, coins: DataFrame) -> DataFrame:
    """``k, chain, by, name, pool``: pools, which count for their chain and for any, and listed coins, which count for all."""
    pools = dex.select(F.lower("symbol").alias("k"), F.col("chain_id").alias("chain"), (-F.coalesce("liquidity", F.lit(0.0))).alias("by"), "name", F.lit(True).alias("pool"))
    return pools.unionByName(coins.select(F.lower("symbol").alias("k"), F.lit(None).cast("string").alias("chain"), F.lit(0.0).alias("by"), "name", F.lit(False).alias("pool")))


def resolve_symbols(queries: DataFrame, dex: DataFrame, coins: DataFrame) -> DataFrame:
    """``queries``: ``query_id, symbol, expected_name, chain``, one row a query.  The deepest candidate and the verdict.

    Candidates are counted per symbol and chain before any query meets them, so a query joins one row.  Names are compared once for each distinct
    expected name and each distinct candidate name of a symbol.
    """
    found = _candidates(dex, coins)
    # A symbol's pools by chain, and its coins (chain NULL, pool false).
    best = F.struct("by", "name")
    by_chain = found.groupBy("k", "pool", "chain").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"), F.max(F.col("name").isNull()).alias("nameless"))
    whole = by_chain.groupBy("k").agg(F.sum("n").alias("all_n"), F.min("best").alias("all_best"), F.max("nameless").alias("all_nameless"),
                                      F.sum(F.when(~F.col("pool"), F.col("n"))).alias("coin_n"), F.min(F.when(~F.col("pool"), F.col("best"))).alias("coin_best"),
                                      F.max(F.when(~F.col("pool"), F.col("nameless"))).alias("coin_nameless"))
    chains = by_chain.where("pool and chain is not null").select("k", "chain", F.col("n").alias("chain_n"), F.col("best").alias("chain_best"), F.col("nameless").alias("chain_nameless"))
    want = queries.withColumn("k", F.lower("symbol")).withColumn("want", F.lower("expected_name"))
    # Which expected names fit a candidate's name.
    wanted = want.where("want is not null").select("k", "chain", "want").distinct()
    names = found.where("name is not null").select("k", F.col("chain").alias("at"), "pool", F.lower("name").alias("given")).distinct()
    fits = F.contains("given", "want") | F.contains("want", "given")
    named = wanted.join(names, "k").where(fits & (F.col("chain").isNull() | ~F.col("pool") | (F.col("chain") == F.col("at")))).select(
        "k", F.col("chain").alias("c"), F.col("want").alias("w"), F.lit(True).alias("named")).distinct()
    j = want.join(whole, "k", "left").join(chains, ["k", "chain"], "left").join(
        named.withColumnRenamed("k", "_k"), (F.col("k") == F.col("_k")) & F.col("chain").eqNullSafe(F.col("c")) & (F.col("want") == F.col("w")), "left")
    anywhere = F.col("chain").isNull()
    n = F.when(anywhere, F.coalesce("all_n", F.lit(0))).otherwise(F.coalesce("chain_n", F.lit(0)) + F.coalesce("coin_n", F.lit(0)))
    top = F.when(anywhere, F.col("all_best")).otherwise(F.least("chain_best", "coin_best"))
    nameless = F.when(anywhere, F.col("all_nameless")).otherwise(F.coalesce("chain_nameless", F.lit(False)) | F.coalesce("coin_nameless", F.lit(False)))
    known = F.col("want").isNull() | F.coalesce("named", F.lit(False)) | F.coalesce(nameless, F.lit(False))
    return j.select(
        "query_id", "symbol", n.alias("matches"), (n > 1).alias("ambiguous"), top["name"].alias("best_name"),
        F.when(n == 0, "BLOCK").when(~known, "FLAG").when(n > 1, "FLAG").otherwise("PASS").alias("verdict"))


def order_risk(orders: DataFrame, snapshot: DataFrame, pairs: DataFrame, quotes: DataFrame, as_of: str) -> DataFrame:
    """``orders``: ``order_id, symbol, token, chain, asset_type, trade_usd, leverage, portfolio_value_usd``, one row an order.

    Token checks run where a token is given, the position check where a portfolio value is given, the
    price check always.  One pass: token, pool and price facts are looked up and every gate is judged inside the row.
    """
    whole = lambda df, key, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    j = (orders.join(whole(_token_facts(snapshot), "token", "rug"), "token", "left").join(whole(best_pairs(pairs), "token", "pool"), "token", "left")
         .join(whole(_agreed_prices(quotes, as_of), "symbol", "agreed"), "symbol", "left"))
    of = lambda name: lambda c: F.col(name)[c]
    chain, lev, total = F.coalesce("chain", F.lit("solana")), F.coalesce("leverage", F.lit(1.0)), F.col("portfolio_value_usd")
    share = F.when(total > 0, F.col("trade_usd") * lev / F.when(total > 0, total) * 100)
    bad = F.coalesce(share > 25, F.lit(False)) | (lev > 3)
    token, sized = F.col("token").isNotNull(), total.isNotNull()
    gates = [
        ("rug", token, _outcome(_token_risks(of("rug"), chain))),
        ("liquidity", token, _outcome(_liquidity_risks(of("pool"), _impact(F.col("trade_usd"), F.col("pool.liquidity"))))),
        ("price", F.lit(True), _outcome(_price_risks(of("agreed"), F.col("asset_type"), F.lit(None).cast("double")))),
        ("position", sized, F.struct(F.when(bad, 2).otherwise(0).alias("rank"), F.when(bad, 100.0).otherwise(0.0).alias("score"))),
    ]
    ran = F.filter(F.array(*[F.when(runs, F.struct(F.lit(name).alias("gate"), o["rank"].cast("int").alias("rank"), o["score"].cast("double").alias("score"))) for name, runs, o in gates]), lambda g: g.isNotNull())
    g = j.select(F.col("order_id").alias("subject_id"), ran.alias("g"))
    return g.select(
        "subject_id", verdict_name(F.array_max(F.transform("g", lambda x: x["rank"]))).alias("verdict"), F.array_max(F.transform("g", lambda x: x["score"])).alias("score"),
        F.get(F.filter("g", lambda x: x["rank"] == 2), F.lit(0))["gate"].alias("blocked_by"), F.size("g").cast("long").alias("gates_run"))
