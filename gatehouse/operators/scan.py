"""Detector tables over text columns: regex, optional check-digit test, overlap resolution.

Everything here stays inside the row: detectors give arrays of spans and one fold resolves overlaps.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows
from gatehouse.functions.spans import find_spans, line_of
from gatehouse.operators.findings import SEVERITY_RANK


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    severity: str
    jurisdiction: str | None
    regex: str
    confidence: float
    needs: str
    validated: bool = True
    check: Callable[[Column], Column] | None = None


RAW_SPAN = ("array<struct<start:int,by_severity:int,by_validated:int,by_length:int,by_detector:int,end:int,rule_id:string,"
            "category:string,severity:string,validated:boolean,confidence:double,jurisdiction:string,raw:string>>")


def _detector_spans(text: Column, d: Detector, order: int) -> Column:
    found = find_spans(text, d.regex)
    if d.check is not None:
        found = F.filter(found, lambda s: d.check(s["raw"]))
    # Fields in the order that decides overlaps: start, then severity, validation and length, then
    # detector order for full ties.
    shaped = F.transform(found, lambda s: F.struct(
        s["start"].alias("start"),
        F.lit(-SEVERITY_RANK[d.severity]).alias("by_severity"),
        F.lit(0 if d.validated else 1).alias("by_validated"),
        (-F.length(s["raw"])).alias("by_length"),
        F.lit(order).alias("by_detector"),
        (s["start"] + F.length(s["raw"])).alias("end"),
        F.lit(d.name).alias("rule_id"),
        F.lit(d.category).alias("category"),
        F.lit(d.severity).alias("severity"),
        F.lit(d.validated).alias("validated"),
        F.lit(d.confidence).alias("confidence"),
        F.lit(d.jurisdiction).cast("string").alias("jurisdiction"),
        s["raw"].alias("raw"),
    ))
    # ``needs`` is a cheap pattern inside every match: most rows stop here.
    return F.when(text.rlike(d.needs), shaped).otherwise(F.array().cast(RAW_SPAN))


def with_raw_spans(df: DataFrame, text_col: str, detectors: list[Detector], allow_types: list[str] | None = None,
                   jurisdictions: list[str] | None = None, out: str = "raw_spans") -> DataFrame:
    """Add all detector hits as one sorted array.  Allow-listed detectors are left out before overlaps
    are resolved, so that what they would have covered stays visible to the others."""
    active = [
        (i, d) for i, d in enumerate(detectors)
        if d.name not in (allow_types or [])
        and (jurisdictions is None or d.jurisdiction is None or d.jurisdiction in jurisdictions)
    ]
    parts = [_detector_spans(F.col(text_col), d, i).cast(RAW_SPAN) for i, d in active]
    joined = F.concat(*parts) if parts else F.array().cast(RAW_SPAN)
    return df.withColumn(out, F.when(F.col(text_col).isNull(), F.array().cast(RAW_SPAN)).otherwise(F.array_sort(joined)))


def keep_disjoint(spans: Column) -> Column:
    """Walk spans in sorted order and keep each one that starts at or after the end of the last kept."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("upto"), F.array().cast(RAW_SPAN).alias("kept")),
        lambda acc, s: F.when(s["start"] >= acc["upto"],
                              F.struct(s["end"].alias("upto"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )


def resolve_overlaps(df: DataFrame, spans_col: str = "raw_spans", out: str = "spans") -> DataFrame:
    return df.withColumn(out, keep_disjoint(F.col(spans_col)))


def explode_spans(scanned: DataFrame, id_col: str, text_col: str, mask_with, spans_col: str = "spans") -> DataFrame:
    rows = F.transform(
        F.col(spans_col), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["rule_id"].alias("rule_id"),
            s["category"].alias("category"), s["severity"].alias("severity"), s["validated"].alias("validated"),
            s["confidence"].alias("confidence"), s["jurisdiction"].alias("jurisdiction"),
            mask_with(s["raw"]).alias("matched"), line_of(F.col(text_col), s["start"]).alias("line"),
        ))
    return explode_rows(scanned, [F.col(id_col).alias("subject_id")], rows, "s").select("subject_id", "s.*")
