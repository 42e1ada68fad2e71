"""Approximate token counts and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.patterns import WHITE

# USD per million input and output tokens, context window.
PRICES = {
    "gpt-4": (10.0, 30.0, 128_000),
    "gpt-3.5": (0.5, 1.5, 16_000),
    "claude": (3.0, 15.0, 200_000),
    "gemini": (1.25, 5.0, 1_000_000),
    "generic": (2.0, 6.0, 128_000),
}
MESSAGE_OVERHEAD = 3
REPLY_PRIMING = 3

_SPECIAL = r"<\|[^|]*?\|>"
_STRUCTURAL = "{}()[];=<>+-*/%&|!~^"


def token_estimate(text: Column) -> Column:
    """Special tokens count one each; the rest by characters, 3.5 per token for code and 4 for prose."""
    special = F.contains(text, F.lit("<|"))
    body = F.when(special, F.regexp_replace(text, _SPECIAL, "")).otherwise(text)
    size = F.length(body)
    # Lengths before and after dropping characters: no array of matches is built.
    code_like = (size - F.length(F.translate(body, _STRUCTURAL, ""))) * 100 > size * 3
    body_tokens = F.when(code_like, F.floor((size * 2 + 6) / 7)).otherwise(F.floor((size + 3) / 4))
    return (body_tokens + F.when(special, F.regexp_count(text, F.lit(_SPECIAL))).otherwise(0)).cast("long")


def word_count(text: Column) -> Column:
    """Runs of non-blank characters."""
    blanks = F.translate(text, WHITE, " " * len(WHITE))
    packed = F.trim(F.regexp_replace(blanks, " {2,}", " "))
    return F.when(packed == "", 0).otherwise(F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit(""))) + 1)


def token_counts(df: DataFrame, keys: list[str], text_col: str, model: str = "generic") -> DataFrame:
    price_in, price_out, _ = PRICES[model]
    text = F.col(text_col)
    counted = df.select(*keys, token_estimate(text).alias("tokens"), F.length(text).alias("characters"),
                        word_count(text).alias("words"))
    return counted.select(*keys, "tokens", "characters", "words",
                          (F.col("tokens") * price_in / 1_000_000).alias("input_cost_usd"),
                          F.lit(1000 * price_out / 1_000_000).alias("output_cost_1k_usd"))


def conversation_tokens(df: DataFrame, conv_col: str, text_col: str, model: str = "generic") -> DataFrame:
    price_in, price_out, window = PRICES[model]
    total = F.sum(F.col("t") + MESSAGE_OVERHEAD) + REPLY_PRIMING
    return (
        df.select(F.col(conv_col).alias("conv_id"), token_estimate(F.col(text_col)).alias("t"))
        .groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), total.alias("total_tokens"))
        .select("conv_id", "messages", "total_tokens",
                (F.col("total_tokens") * price_in / 1_000_000).alias("input_cost_usd"),
                F.lit(1000 * price_out / 1_000_000).alias("output_cost_1k_usd"),
                (F.lit(window) - F.col("total_tokens")).alias("context_window_remaining"))
    )
