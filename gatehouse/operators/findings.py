"""Findings and how they become verdicts.

Every scanner returns the same long table of findings.  Verdicts aggregate it per subject with partial
aggregates only, so one subject holding a third of all findings still reduces on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity order and the score of the worst severity.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_SCORE = {"low": 15, "medium": 40, "high": 70, "critical": 100}
VERDICT_RANK = {"PASS": 0, "FLAG": 1, "BLOCK": 2}

FINDING_COLUMNS = ["subject_id", "tool", "rule_id", "category", "severity", "sev_rank", "position", "start", "end",
                   "line", "matched", "message", "score"]


def pick(mapping: dict, col: Column, default=None) -> Column:
    """Small constant map as a CASE."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(col: Column) -> Column:
    return pick(SEVERITY_RANK, col)


def verdict_name(rank: Column) -> Column:
    return F.when(rank == 2, "BLOCK").when(rank == 1, "FLAG").otherwise("PASS")


def verdict_rank(col: Column) -> Column:
    return pick(VERDICT_RANK, col, 0)


def base_verdict(n: Column, worst: Column, threshold: str, mode: str, ranks: dict | None = None) -> Column:
    """PASS without findings, BLOCK from ``threshold`` on, else FLAG; then the enforcement mode."""
    limit = (ranks or SEVERITY_RANK)[threshold]
    blocked = {"block": "BLOCK", "flag": "FLAG", "audit": "PASS"}[mode]
    flagged = "PASS" if mode == "audit" else "FLAG"
    return F.when(F.coalesce(n, F.lit(0)) == 0, "PASS").when(worst >= limit, blocked).otherwise(flagged)


def as_findings(df: DataFrame, tool: str) -> DataFrame:
    """Complete a partial findings table to the shared schema."""
    types = {"position": "int", "start": "int", "end": "int", "line": "int", "sev_rank": "int", "score": "double"}
    have = set(df.columns)
    cols = []
    for name in FINDING_COLUMNS:
        if name == "tool":
            cols.append(F.lit(tool).alias("tool"))
        elif name == "sev_rank" and name not in have:
            cols.append(severity_rank(F.col("severity")).cast("int").alias("sev_rank"))
        elif name == "score" and name not in have:
            cols.append(pick(SEVERITY_SCORE, F.col("severity")).cast("double").alias("score"))
        elif name in have:
            cols.append(F.col(name).cast(types[name]).alias(name) if name in types else F.col(name))
        else:
            cols.append(F.lit(None).cast(types.get(name, "string")).alias(name))
    return df.select(*cols)


def verdicts(findings: DataFrame, subjects: DataFrame, threshold: str = "high", mode: str = "block",
             subject_col: str = "subject_id") -> DataFrame:
    """One row per subject; subjects without findings survive through the outer join and PASS."""
    worst = findings.groupBy("subject_id").agg(
        F.max("sev_rank").alias("worst_rank"), F.count(F.lit(1)).alias("total_findings"))
    people = subjects.select(F.col(subject_col).alias("subject_id"))
    return people.join(worst, "subject_id", "left").select(
        "subject_id",
        base_verdict(F.col("total_findings"), F.col("worst_rank"), threshold, mode).alias("verdict"),
        F.coalesce("worst_rank", F.lit(0)).alias("worst_rank"),
        F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("subject_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def claim_verdict(claims: DataFrame, subjects: DataFrame, mode: str = "block", subject_col: str = "subject_id") -> DataFrame:
    """Worst claim wins; ``audit`` turns BLOCK into FLAG, ``flag`` changes nothing; score is the mean
    of PASS 1, FLAG 0.5 and BLOCK 0, and 1 without claims."""
    rank = verdict_rank(F.col("verdict"))
    agg = claims.groupBy("subject_id").agg(
        F.max(rank).alias("worst"), F.sum(2 - rank).alias("points"), F.count(F.lit(1)).alias("n"))
    worst = F.coalesce("worst", F.lit(0))
    if mode == "audit":
        worst = F.least(worst, F.lit(1))
    return subjects.select(F.col(subject_col).alias("subject_id")).join(agg, "subject_id", "left").select(
        "subject_id", verdict_name(worst).alias("verdict"),
        F.coalesce(F.col("points") / (F.col("n") * 2), F.lit(1.0)).alias("overall_score"),
        F.coalesce("n", F.lit(0)).alias("claims"),
    )


def compose_gates(gates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Combine ``(name, DataFrame[subject_id, verdict, score])``: worst verdict, highest score, and the
    first blocking gate in list order."""
    parts = [
        df.select("subject_id", "verdict", F.col("score").cast("double").alias("score"),
                  F.lit(name).alias("gate"), F.lit(i).alias("ordinal"))
        for i, (name, df) in enumerate(gates)
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("rank", verdict_rank(F.col("verdict")))
        .groupBy("subject_id")
        .agg(
            F.max("rank").alias("worst"), F.max("score").alias("score"),
            F.min(F.when(F.col("rank") == 2, F.struct("ordinal", "gate")))["gate"].alias("blocked_by"),
            F.count(F.lit(1)).alias("gates_run"),
        )
        .select("subject_id", verdict_name(F.col("worst")).alias("verdict"), "score", "blocked_by", "gates_run")
    )


def suppress(findings: DataFrame, allow: DataFrame, on: str = "rule_id") -> DataFrame:
    """Drop findings whose rule is on the allow table."""
    return findings.join(allow.select(F.col(allow.columns[0]).alias(on)).distinct(), on, "left_anti").select(*findings.columns)


def dedupe_findings(findings: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Keep the first finding per key.  ``min(struct)`` combines on the map side; no group is sorted."""
    keys = keys or ["subject_id", "rule_id", "matched"]
    order = order or ["position", "start", "message"]
    rest = [c for c in findings.columns if c not in keys and c not in order]
    lead = [c for c in order if c in findings.columns and c not in keys]
    # NULLs order first inside structs, as a missing position means the document itself.
    first = F.min(F.struct(*lead, *rest)).alias("_first")
    return findings.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*findings.columns)


def attach_certificate(df: DataFrame, subject: str, verdict: str = "verdict", count: str = "total_findings",
                       issued_ms: str = "issued_ms", form: str = "gate") -> DataFrame:
    return df.withColumn("certificate", certificate(F.col(subject), F.col(verdict),
                                                    F.col(count) if form == "gate" else None, F.col(issued_ms), form))


def certificate(subject: Column, verdict: Column, count: Column | None, issued_ms: Column, form: str = "gate") -> Column:
    """``gate``: hash of ``sha256(subject):verdict:findings:time``; ``claims``: ``input|verdict|time``."""
    if form == "gate":
        preimage = F.concat_ws(":", F.sha2(subject, 256), verdict, count.cast("string"), issued_ms.cast("string"))
    else:
        preimage = F.concat_ws("|", subject, verdict, issued_ms.cast("string"))
    return F.concat(F.lit("sha256:"), F.sha2(preimage, 256))


def verify_certificates(df: DataFrame, subject: str, verdict: str = "verdict", count: str = "total_findings",
                        issued_ms: str = "issued_ms", form: str = "gate") -> DataFrame:
    """Rows whose stored certificate does not follow from the row."""
    expected = certificate(F.col(subject), F.col(verdict), F.col(count) if form == "gate" else None, F.col(issued_ms), form)
    return df.where(~F.col("certificate").eqNullSafe(expected)).withColumn("expected_certificate", expected)


def staged_pipeline(outputs: DataFrame, stages: list[tuple]) -> DataFrame:
    """Stop at the first stage whose verdict table says BLOCK for the subject; FLAG goes on.

    ``stages`` holds ``(name, DataFrame[subject_id, verdict], credits)`` in running order, and a fourth part where a stage
    only runs for some: their ``DataFrame[subject_id]``.  A stage that has no row for a subject did not block it.
    Credits are those of all stages reached and run.
    """
    parts = []
    for i, (name, df, _, *only) in enumerate(stages):
        row = lambda *more, i=i, name=name: ["subject_id", F.lit(i).alias("ordinal"), F.lit(name).alias("stage"), *more]
        parts.append(df.where("verdict = 'BLOCK'").select(*row(F.lit(True).alias("stops"))))
        if only:
            parts.append(only[0].distinct().select(*row(F.lit(False).alias("stops"))))
    some = [i for i, stage in enumerate(stages) if len(stage) > 3]
    marks = reduce(DataFrame.unionByName, parts).groupBy("subject_id").agg(
        F.min(F.when(F.col("stops"), F.struct("ordinal", "stage"))).alias("stop"), *[F.max((F.col("ordinal") == i) & ~F.col("stops")).alias(f"runs_{i}") for i in some])
    last = F.coalesce("stop.ordinal", F.lit(len(stages) - 1))
    price = lambda i: F.when(last >= i, F.lit(stages[i][2]) if i not in some else F.when(F.col(f"runs_{i}"), stages[i][2]).otherwise(0)).otherwise(0)
    return outputs.select("subject_id").join(marks, "subject_id", "left").select(
        "subject_id", F.col("stop").isNull().alias("passed"), F.col("stop.stage").alias("blocked_at"),
        reduce(lambda a, b: a + b, [price(i) for i in range(len(stages))]).alias("credits_used"),
    )


