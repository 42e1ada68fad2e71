"""Evaluate a sub-expression once inside a larger one."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that it is neither planned nor run again
    for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_rows(df: DataFrame, keep: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push it to the scan, which computes
    the whole array twice; the outer form with a filter on the element does not.
    """
    if position is None:
        out = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return out.where(F.col(name).isNotNull())
