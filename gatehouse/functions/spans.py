"""Matches with their offsets, built from ``split`` and ``regexp_extract_all``.

The two functions cut a text into gaps and matches that alternate, so one running sum over both gives
every start offset inside the row: no explode, no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,raw:string>>"


def find_spans(text: Column, regex: str) -> Column:
    """``array<struct<start,raw>>`` of all matches, left to right (0-based code point offsets)."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(hits)), hits,
        lambda gap, raw: F.struct(F.length(gap).alias("gap"), raw.alias("raw")),
    )
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["raw"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["raw"].alias("raw")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    # Most rows match nothing: one regex search, then the cheap branch.
    return F.when(text.rlike(regex), walked).otherwise(F.array().cast(SPAN_TYPE))


def line_of(text: Column, start: Column) -> Column:
    """1-based line number of a 0-based offset."""
    before = F.substring(text, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def mask(raw: Column) -> Column:
    """Letters and digits become ``*``; separators and the length stay."""
    return F.regexp_replace(raw, "[A-Za-z0-9]", "*")


def splice(text: Column, spans: Column, label) -> Column:
    """Replace disjoint, ordered spans (``start``/``end`` fields) by ``label(span)``."""
    def piece(span: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, before + 1, span["start"] - before), label(span))

    tail_from = F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.get(spans, F.size(spans) - 1)["end"])
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, tail_from + 1, F.length(text)))
    )
