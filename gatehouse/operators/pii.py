"""Personal data in a text table: spans, overlap resolution, redaction and reports.

The whole scan stays inside the row: detectors give arrays of spans, one fold resolves overlaps and
one transform writes the redacted text.  Only corpus reports shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.checksums import digits_of, iban_checksum_ok, luhn, nhs_ok
from gatehouse.functions.patterns import EDGE, SPACE
from gatehouse.functions.spans import mask, splice
from gatehouse.operators.findings import SEVERITY_RANK, SEVERITY_SCORE, as_findings, base_verdict, pick
from gatehouse.operators.scan import Detector, explode_spans, resolve_overlaps, with_raw_spans


def _compact(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, SPACE, ""))


_W = "[A-Za-z0-9_]"
# A digit that no word character precedes.  Testing the digit first lets the regex engine skip ahead.
_D = rf"[0-9](?<!{_W}[0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_RUN = r"[0-9](?:[ -]?[0-9]){8}"

# Patterns, categories, severities and confidences of the detectors.
DETECTORS = [
    Detector("credit_card", "PCI", "critical", None, _D + rf"(?:[ -]?[0-9]){{12,18}}(?!{_W})", 0.99, needs=_RUN,
             check=lambda raw: luhn(digits_of(raw))),
    Detector("us_ssn", "PII", "critical", "US",
             _D + rf"(?<!0(?=00)|6(?=66)|9)[0-9]{{2}}[- ](?!00)[0-9]{{2}}[- ](?!0000)[0-9]{{4}}(?!{_W})", 0.9, needs=_RUN),
    Detector("iban", "PCI", "high", None,
             rf"[A-Z](?<!{_W}[A-Z])[A-Z][0-9]{{2}}(?:{SPACE}?[A-Z0-9]){{11,30}}(?!{_W})", 0.98, needs="[A-Z]{2}[0-9]{2}",
             check=lambda raw: iban_checksum_ok(_compact(raw))),
    Detector("uk_nhs", "PHI", "high", "UK", _D + rf"[0-9]{{2}}[ -]?[0-9]{{3}}[ -]?[0-9]{{4}}(?!{_W})", 0.97, needs=_RUN,
             check=lambda raw: nhs_ok(digits_of(raw))),
    Detector("ca_sin", "PII", "high", "CA", _D + rf"[0-9]{{2}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}(?!{_W})", 0.9, needs=_RUN,
             check=lambda raw: luhn(digits_of(raw))),
    Detector("email", "PII", "medium", None, EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + EDGE, 0.9,
             needs="@[A-Za-z0-9.-]"),
    Detector("phone", "PII", "low", None,
             rf"(?<!{_W})(?:\+?1[ .\-]?)?(?:\([0-9]{{3}}\)[ .\-]?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}(?!{_W})",
             0.5, validated=False, needs=r"[0-9]{3}[ .\-][0-9]{4}"),
    Detector("ip_address", "PII", "low", None, EDGE + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + EDGE, 0.6,
             needs=r"[0-9]\.[0-9]{1,3}\.[0-9]"),
]

def scan_pii(df: DataFrame, text_col: str, **policy) -> DataFrame:
    """``df`` plus ``spans``: the disjoint spans of each row."""
    return resolve_overlaps(with_raw_spans(df, text_col, DETECTORS, **policy)).drop("raw_spans")


def pii_spans(df: DataFrame, id_col: str, text_col: str, resolved: bool = True, **policy) -> DataFrame:
    """Long table of spans, masked; ``resolved=False`` keeps overlapping hits."""
    narrow = df.select(id_col, text_col)
    if resolved:
        return explode_spans(scan_pii(narrow, text_col, **policy), id_col, text_col, mask)
    return explode_spans(with_raw_spans(narrow, text_col, DETECTORS, **policy), id_col, text_col, mask, "raw_spans")


def pii_findings(df: DataFrame, id_col: str, text_col: str, **policy) -> DataFrame:
    return as_findings(pii_spans(df, id_col, text_col, **policy).withColumn("position", F.col("start")), "pii")


def redact(df: DataFrame, id_col: str, text_col: str, **policy) -> DataFrame:
    """Every span replaced by its typed placeholder."""
    scanned = scan_pii(df.select(id_col, text_col), text_col, **policy)
    return scanned.select(
        F.col(id_col).alias("subject_id"),
        splice(F.col(text_col), F.col("spans"),
               lambda s: F.concat(F.lit("[REDACTED_"), F.upper(s["rule_id"]), F.lit("]"))).alias("redacted_text"),
        F.size("spans").alias("total_findings"),
    )


def _count_severity(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["severity"] == name))


def pii_report(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, threshold: str = "high",
               mode: str = "block", **policy) -> DataFrame:
    """One row per text: verdict, worst score, distinct categories and the severity histogram."""
    keep = keep or []
    scanned = scan_pii(df.select(id_col, text_col, *keep), text_col, **policy)
    # Materialise small fields only; the text itself does not travel further.
    spans = F.col("spans")
    worst = F.coalesce(-F.array_min(F.transform(spans, lambda s: s["by_severity"])), F.lit(0))
    base = scanned.select(
        F.col(id_col).alias("subject_id"), *keep, F.size(spans).alias("total_findings"), worst.alias("worst_rank"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["category"])))).alias("categories"),
        *[_count_severity(spans, name).alias(f"n_{name}") for name in SEVERITY_RANK],
    )
    score_by_rank = {SEVERITY_RANK[s]: SEVERITY_SCORE[s] for s in SEVERITY_RANK}
    return base.select(
        "subject_id", *keep,
        base_verdict(F.col("total_findings"), F.col("worst_rank"), threshold, mode).alias("verdict"),
        (F.col("total_findings") == 0).alias("safe"),
        pick(score_by_rank, F.col("worst_rank"), 0).alias("score"),
        "categories", "total_findings", *[f"n_{name}" for name in SEVERITY_RANK],
    )


def pii_corpus_report(df: DataFrame, id_col: str, text_col: str, dims: list[str], **policy) -> DataFrame:
    """Verdict and finding totals rolled up over descriptive columns."""
    report = pii_report(df, id_col, text_col, keep=dims, **policy)
    return report.rollup(*dims).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("verdict") == "PASS").alias("passed"),
        F.count_if(F.col("verdict") == "FLAG").alias("flagged"),
        F.count_if(F.col("verdict") == "BLOCK").alias("blocked"),
        F.sum("total_findings").alias("findings"),
        *[F.sum(f"n_{name}").alias(f"n_{name}") for name in SEVERITY_RANK],
        F.max("score").alias("worst_score"),
    )
