"""Shorten conversations to a token budget by TF-IDF importance.

System messages and the last three others are pinned.  The rest is taken greedily by score while it
fits.  What remains of the budget never grows, so of all candidates of one length only the first
``budget / length`` in score order can ever be taken: the greedy fold sees a list bounded by the budget
whatever the size of the conversation, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatehouse.operators.tokens import conversation_tokens
from gatehouse.operators.usage import ENDPOINT_CREDITS

CHARS_PER_TOKEN = 4
RECENT = 3


def _terms(text):
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.filter(words, lambda w: F.length(w) > 1)


def tfidf_scores(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, score`` over non-system messages; rounded so that sums of doubles compare equal."""
    talk = messages.where("role <> 'system'").select("conv_id", "turn", _terms(F.col("text")).alias("terms"))
    # Partial aggregation collapses a message's repeated terms before the shuffle.
    tf = (
        talk.select("conv_id", "turn", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
        .groupBy("conv_id", "turn", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("df"))
    size = messages.where("role <> 'system'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_msgs"))
    idf = df.join(size, "conv_id").select(
        "conv_id", "term", (F.log((F.col("n_msgs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    scored = tf.join(idf, ["conv_id", "term"]).groupBy("conv_id", "turn").agg(
        F.sum(F.col("tf") / F.col("n_terms") * F.col("idf")).alias("score"))
    return talk.select("conv_id", "turn").join(scored, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def _plan(messages: DataFrame, target_tokens: int, preserve_system: bool) -> tuple[DataFrame, DataFrame]:
    budget = target_tokens * CHARS_PER_TOKEN
    sized = messages.select("conv_id", "turn", "role", F.length("text").alias("chars"))
    talk = sized.where("role <> 'system'")

    # The top-k rank filter runs before the shuffle as well (window group limit).
    recent = (
        talk.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
        .where(F.col("r") <= RECENT)
        .groupBy("conv_id").agg(F.min("turn").alias("recent_from"), F.sum("chars").alias("recent_chars"))
    )
    totals = sized.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("original_count"),
        F.sum(F.when(F.col("role") == "system", F.col("chars")).otherwise(0)).alias("system_chars"),
        F.count_if(F.col("role") == "system").alias("system_count"),
    )
    if not preserve_system:
        totals = totals.withColumn("system_chars", F.lit(0).cast("long")).withColumn("system_count", F.lit(0).cast("long"))
    head = totals.join(recent, "conv_id", "left").select(
        "conv_id", "original_count", "system_count", "system_chars", F.coalesce("recent_chars", F.lit(0)).alias("recent_chars"),
        "recent_from", (F.lit(budget) - F.col("system_chars") - F.coalesce("recent_chars", F.lit(0))).alias("room"))

    scores = tfidf_scores(messages)
    ranked = (
        talk.join(scores, ["conv_id", "turn"]).where(F.col("chars").between(1, budget))
        .join(head.select("conv_id", "recent_from", "room"), "conv_id")
        .where((F.col("turn") < F.col("recent_from")) & (F.col("chars") <= F.col("room")))
        .withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "chars").orderBy(F.desc("score"), "turn")))
        .where((F.col("r") <= budget) & (F.col("r") * F.col("chars") <= budget))
    )
    bag = ranked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by_score"), "turn", "chars"))).alias("bag"))
    start = F.struct(
        F.col("room").cast("long").alias("room"), F.array().cast("array<bigint>").alias("taken"),
        F.lit(0).cast("long").alias("taken_chars"),
        F.lit(None).cast("struct<by_score:double,turn:bigint>").alias("stop"))

    def step(acc, m):
        fits = (acc["room"] > 0) & (m["chars"] <= acc["room"])
        left = acc["room"] - m["chars"]
        return F.when(fits, F.struct(
            left.cast("long").alias("room"), F.concat(acc["taken"], F.array(m["turn"].cast("long"))).alias("taken"),
            (acc["taken_chars"] + m["chars"]).cast("long").alias("taken_chars"),
            F.when(left <= 0, F.struct(m["by_score"].alias("by_score"), m["turn"].cast("long").alias("turn"))).alias("stop"),
        )).otherwise(acc)

    folded = head.join(bag, "conv_id", "left").select(
        "*", F.aggregate(F.coalesce("bag", F.array().cast("array<struct<by_score:double,turn:bigint,chars:int>>")), start, step).alias("f"))
    plan = folded.select("conv_id", "original_count", "system_count", "system_chars", "recent_chars", "recent_from", "room",
                         F.col("f.taken").alias("taken"), F.col("f.taken_chars").alias("taken_chars"), F.col("f.stop").alias("stop"))
    return plan, scores


def distill(messages: DataFrame, target_tokens: int, preserve_system: bool = True) -> DataFrame:
    """The kept messages; ``part`` 0 system, 1 selected, 2 recent gives the output order with ``turn``."""
    plan, scores = _plan(messages, target_tokens, preserve_system)
    rows = messages.join(plan, "conv_id").join(scores.withColumnRenamed("score", "s"), ["conv_id", "turn"], "left")
    # Empty messages use no budget: they are kept while the walk has not stopped before their place.
    key = F.struct((-F.coalesce("s", F.lit(0.0))).alias("by_score"), F.col("turn").cast("long").alias("turn"))
    empty_kept = (F.length("text") == 0) & (F.col("room") > 0) & (F.col("stop").isNull() | (key < F.col("stop")))
    part = (
        F.when(F.col("role") == "system", F.lit(0) if preserve_system else F.lit(None).cast("int"))
        .when(F.col("turn") >= F.col("recent_from"), 2)
        .when(F.array_contains("taken", F.col("turn").cast("long")) | empty_kept, 1)
    )
    return rows.withColumn("part", part).where("part is not null").select("conv_id", "turn", "role", "text", "part")


def distill_summary(messages: DataFrame, target_tokens: int, preserve_system: bool = True) -> DataFrame:
    kept = distill(messages, target_tokens, preserve_system).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("distilled_count"), F.sum(F.length("text")).alias("used_chars"))
    size = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("original_count"))
    # Scaled integers: ratio in hundredths, halves rounded up.
    return size.join(kept, "conv_id", "left").select(
        "conv_id", "original_count", F.coalesce("distilled_count", F.lit(0)).alias("distilled_count"),
        F.floor((F.coalesce("used_chars", F.lit(0)) + CHARS_PER_TOKEN - 1) / CHARS_PER_TOKEN).alias("estimated_tokens"),
        (F.floor((F.coalesce("distilled_count", F.lit(0)) * 200 + F.col("original_count")) / (F.col("original_count") * 2)) / 100).alias("compression_ratio"))


# Tokens from which a conversation is flagged and, beyond, distilled; tokens it is distilled to.
CONTEXT_WARN_TOKENS = 3000
CONTEXT_TARGET_TOKENS = 4000


def manage_context(messages: DataFrame, model: str = "generic", warn_tokens: int = CONTEXT_WARN_TOKENS, target_tokens: int = CONTEXT_TARGET_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The context step of an agent: every conversation is counted, those over ``warn_tokens`` are distilled.

    First the messages to go on with (``conv_id, turn, role, text``; conversations within the limit are whole), then one row a conversation: ``conv_id,
    total_tokens, status`` (pass below the limit, else flag), ``distilled, original_count, kept_count, savings_pct`` and the ``credits`` of the calls made.
    """
    counted = conversation_tokens(messages, "conv_id", "text", model).select("conv_id", F.col("messages").alias("original_count"), "total_tokens")
    over = counted.where(F.col("total_tokens") > warn_tokens).select("conv_id")
    columns = ["conv_id", "turn", "role", "text"]
    short = distill(messages.join(over, "conv_id", "left_semi"), target_tokens).select(*columns)
    kept = messages.join(over, "conv_id", "left_anti").select(*columns).unionByName(short)
    sizes = short.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    is_over = F.col("total_tokens") > warn_tokens
    n = F.when(is_over, F.coalesce("n", F.lit(0))).otherwise(F.col("original_count"))
    ratio = F.floor((n * 200 + F.col("original_count")) / (F.col("original_count") * 2))  # hundredths, halves up
    calls = F.lit(ENDPOINT_CREDITS["/v1/tokens/count"]) + F.when(is_over, ENDPOINT_CREDITS["/v1/distill"]).otherwise(0)
    checks = counted.join(sizes, "conv_id", "left").select(
        "conv_id", "total_tokens", F.when(F.col("total_tokens") < warn_tokens, "pass").otherwise("flag").alias("status"), is_over.alias("distilled"), "original_count",
        n.alias("kept_count"), (100 - ratio).alias("savings_pct"), calls.cast("long").alias("credits"))
    return kept, checks
