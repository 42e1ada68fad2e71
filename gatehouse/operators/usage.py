"""Reports over the request log.

``log`` columns: ``id, ts, path, method, api_key, ip, status, latency_ms, verdict, language, check_types,
hallucinated_packages``.  Every report is one filter and partial aggregates; nothing is ranked globally
except bounded pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatehouse.operators.findings import pick

# Credits per endpoint (others cost 1), lamports per credit and lamports per SOL.
ENDPOINT_CREDITS = {
    "/v1/validate/imports": 1, "/v1/verify": 2, "/v1/distill": 1, "/v1/scan/secrets": 1, "/v1/scan/injection": 1,
    "/v1/scan/pii": 1, "/v1/tokens/count": 1, "/v1/scan/vulnerabilities": 2, "/v1/finance/units": 1,
    "/v1/finance/price": 2, "/v1/finance/symbol": 1, "/v1/finance/token/risk": 3, "/v1/finance/slippage": 2,
    "/v1/finance/order/risk": 5, "/v1/finance/position/check": 1, "/v1/compliance/sanctions": 1,
    "/v1/health/rx-check": 2, "/v1/agent/tool-args": 1, "/v1/infra/plan/risk": 2, "/v1/legal/cite": 2,
    "/v1/legal/deadline": 1, "/v1/validate/identifier": 1, "/v1/validate/schema": 1, "/v1/scan/sql": 1,
    "/v1/scan/command": 1, "/v1/scan/url": 1,
}
LAMPORTS_PER_CREDIT = 100_000
LAMPORTS_PER_SOL = 1_000_000_000
FREE_CALLS = 10
MAX_AGE_SECONDS = 86_400


def in_window(log: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """The ``hours`` up to ``as_of``, both ends included."""
    end = F.lit(as_of).cast("timestamp")
    return log.where((F.col("ts") >= end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= end))


# Standard deviation of an estimated count: five of them are the 5 percent within which an estimate is to lie.
ESTIMATE_RSD = 0.01


def usage_overview(log: DataFrame, as_of: str, hours: int = 24, approximate: bool = False) -> DataFrame:
    """``approximate`` estimates the active keys, to within 5 percent."""
    keys = F.approx_count_distinct("api_key", ESTIMATE_RSD) if approximate else F.count_distinct("api_key")
    return in_window(log, as_of, hours).agg(
        F.count(F.lit(1)).alias("total_calls"), keys.alias("active_keys"),
        F.coalesce(F.avg(F.when(F.col("status") >= 400, 1.0).otherwise(0.0)), F.lit(0.0)).alias("error_rate"))


def calls_per_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("calls")).orderBy("hour")


def calls_by_endpoint(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.count(F.lit(1)).alias("calls"))


def verdict_distribution(log: DataFrame) -> DataFrame:
    n = {v: F.count_if(F.col("verdict") == v) for v in ("PASS", "FLAG", "BLOCK")}
    total = F.count_if(F.col("verdict").isin("PASS", "FLAG", "BLOCK"))
    return log.agg(n["PASS"].alias("pass"), n["FLAG"].alias("flag"), n["BLOCK"].alias("block"),
                   F.when(total > 0, n["BLOCK"] * 100 / total).otherwise(0.0).alias("block_rate"))


def top_hallucinated_packages(log: DataFrame, k: int = 20) -> DataFrame:
    return (
        log.select(F.coalesce("language", F.lit("unknown")).alias("language"), F.explode("hallucinated_packages").alias("name"))
        .groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "language", "name").limit(k)
    )


def check_type_breakdown(log: DataFrame) -> DataFrame:
    return (log.select(F.explode("check_types").alias("check_type")).groupBy("check_type")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "check_type"))


def request_page(log: DataFrame, limit: int = 100, offset: int = 0, path: str | None = None, verdict: str | None = None) -> DataFrame:
    """Newest first: the rows that pass the filters, then the page of them."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1, offset at least 0")
    rows = log
    if path is not None:
        rows = rows.where(F.col("path") == path)
    if verdict is not None:
        rows = rows.where(F.col("verdict") == verdict)
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def credit_cost(path: Column) -> Column:
    return pick(ENDPOINT_CREDITS, path, 1)


def price_usage(log: DataFrame) -> DataFrame:
    """Credits and revenue per endpoint; calls are counted first, so prices touch one row per path."""
    per_path = calls_by_endpoint(log).withColumn("credits", F.col("calls") * credit_cost(F.col("path")))
    return per_path.withColumn("revenue_sol", F.col("credits") * LAMPORTS_PER_CREDIT / LAMPORTS_PER_SOL)


def free_tier_quota(log: DataFrame, n: int = FREE_CALLS) -> DataFrame:
    """Anonymous calls with ``allowed`` for the first ``n`` of each address.

    The rank filter runs on the map side, so a hot address ships ``n`` rows per task; the n-th call's
    place then decides all others in a join.
    """
    calls = log.where("api_key is null").select("id", "ts", "ip")
    ranked = calls.withColumn("r", F.row_number().over(Window.partitionBy("ip").orderBy("ts", "id"))).where(F.col("r") <= n)
    last = ranked.groupBy("ip").agg(F.max(F.struct("ts", "id")).alias("last_free"))
    return calls.join(last, "ip").select("id", "ts", "ip", (F.struct("ts", "id") <= F.col("last_free")).alias("allowed"))


def payment_error() -> Column:
    """Why an attempt fails on its own, or NULL.  Fixed values: the reasons."""
    age = F.unix_timestamp("attempted_at") - F.unix_timestamp("block_time")
    credits = F.floor(F.col("lamports") / LAMPORTS_PER_CREDIT)
    return (
        F.when(F.col("block_time").isNull(), "missing_block_time").when(age > MAX_AGE_SECONDS, "transaction_too_old")
        .when(~F.col("has_meta"), "missing_tx_meta").when(~F.col("wallet_in_tx"), "service_wallet_not_in_tx")
        .when(F.col("lamports") <= 0, "no_sol_sent_to_service_wallet").when(credits < 1, "amount_too_small")
    )


def credit_payments(attempts: DataFrame) -> DataFrame:
    """``attempts``: ``signature, attempt_id, attempted_at, block_time, has_meta, wallet_in_tx, lamports``.

    The first attempt of a signature that passes all other tests is credited; later ones are replays.
    """
    credits = F.floor(F.col("lamports") / LAMPORTS_PER_CREDIT)
    judged = attempts.withColumn("own", payment_error()).withColumn("place", F.struct("attempted_at", "attempt_id"))
    first = judged.where("own is null").groupBy("signature").agg(F.min("place").alias("first_place"))
    error = F.when(F.col("place") > F.col("first_place"), "already_used").otherwise(F.col("own"))
    return judged.join(first, "signature", "left").withColumn("error", error).select(
        "signature", "attempt_id", F.col("error").isNull().alias("valid"),
        F.when(F.col("error").isNull(), credits).otherwise(0).cast("long").alias("credits"), "error")


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("accounts"), F.coalesce(F.sum("credits"), F.lit(0)).alias("total_credits"),
                      F.coalesce(F.sum("total_calls"), F.lit(0)).alias("total_calls"))


def service_health(probes: DataFrame) -> DataFrame:
    """``probes``: ``service, ts, http_status, latency_ms`` (both NULL without an answer).  Latest probe wins."""
    latest = probes.groupBy("service").agg(
        F.max_by(F.struct("http_status", "latency_ms", "ts"), F.struct("ts", "latency_ms")).alias("p")).select("service", "p.*")
    ok = F.col("http_status").between(200, 399)
    return latest.select(
        "service", F.when(F.col("http_status").isNull(), "down").when(~ok, "degraded").when(F.col("latency_ms") < 200, "ok")
        .when(F.col("latency_ms") < 1000, "degraded").otherwise("down").alias("status"), "latency_ms", F.col("ts").alias("last_checked"))
