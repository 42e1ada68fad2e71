"""Table readers with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Schemas of the JSON feeds; parquet carries its own.
SCHEMAS = {
    "request_log": (
        "id string, ts timestamp, path string, method string, api_key string, ip string, status int, latency_ms double, "
        "credit_cost int, verdict string, language string, hallucination_rate double, check_types array<string>, "
        "hallucinated_packages array<string>"),
    "texts": "subject_id long, text string",
    "payments": "signature string, attempt_id long, attempted_at timestamp, block_time timestamp, has_meta boolean, wallet_in_tx boolean, lamports long",
}


def load(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    path = os.path.join(folder, name if fmt == "json" else f"{name}.parquet")
    if fmt == "json":
        return spark.read.schema(schema or SCHEMAS[name]).json(path)
    return spark.read.parquet(path)
