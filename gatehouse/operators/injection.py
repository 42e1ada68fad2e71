"""Prompt-injection score of a text column: weighted phrases, distinct labels, risk band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.patterns import line_start

# Label, pattern, weight in hundredths.
PATTERNS = [
    ("instruction_override", r"(?i)ignore (all |previous |above |prior )?instructions?", 50),
    ("instruction_override", r"(?i)forget (everything|all)", 50),
    ("instruction_override", r"(?i)disregard (the above|previous)", 50),
    ("instruction_override", r"(?i)new instructions:", 40),
    ("instruction_override", r"(?i)" + line_start() + "system:", 40),
    ("role_hijacking", r"(?i)you are now", 35),
    ("role_hijacking", r"(?i)act as", 30),
    ("role_hijacking", r"(?i)pretend (you are|to be)", 35),
    ("role_hijacking", r"(?i)roleplay as", 35),
    ("role_hijacking", r"(?i)your new (role|persona|instructions)", 40),
    ("jailbreak", r"(?i)DAN mode", 50),
    ("jailbreak", r"(?i)developer mode", 45),
    ("jailbreak", r"(?i)jailbreak", 50),
    ("jailbreak", r"(?i)no restrictions", 45),
    ("jailbreak", r"(?i)without (any )?restrictions", 45),
    ("jailbreak", r"(?i)bypass (your )?(safety|filter|restriction|guideline)", 50),
    ("data_exfiltration", r"(?i)print (your |the |all |system )?(instructions|prompt|system prompt)", 50),
    ("data_exfiltration", r"(?i)reveal (your|the) (system prompt|instructions)", 50),
    ("data_exfiltration", r"(?i)what (are|were) (your|the) (instructions|system prompt)", 45),
    ("encoding_base64", r"[A-Za-z0-9+/]{50}", 30),
    ("unicode_direction_override", r"[‮‏]", 40),
]


def input_guard(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Whether a user's input may go on to a model: ``status`` pass, flag or block by its risk; only safe input may."""
    scored = injection_scores(df, keys, text_col)
    status = F.when(F.col("risk") == "safe", "pass").when(F.col("risk") == "suspicious", "flag").otherwise("block")
    return scored.select(*keys, (F.col("risk") == "safe").alias("safe"), status.alias("status"), "score", "patterns")


def injection_scores(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    text = F.col(text_col)
    hits = F.filter(
        F.array(*[F.when(text.rlike(rx), F.struct(F.lit(label).alias("label"), F.lit(w).alias("weight")))
                  for label, rx, w in PATTERNS]),
        lambda h: h.isNotNull())
    scored = df.select(*keys, hits.alias("hits")).select(
        *keys, F.array_distinct(F.transform("hits", lambda h: h["label"])).alias("labels"),
        # Integer hundredths: no floating rounding before the thresholds.
        F.least(F.aggregate("hits", F.lit(0), lambda acc, h: acc + h["weight"]), F.lit(100)).alias("points"))
    return scored.select(
        *keys,
        F.when(F.col("points") > 60, "injection").when(F.col("points") >= 30, "suspicious").otherwise("safe").alias("risk"),
        (F.col("points") / 100).alias("score"), F.concat_ws(",", "labels").alias("patterns"))
