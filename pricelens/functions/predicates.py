"""Filter predicates built from parameters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_equal(conditions: Mapping[str, object]) -> Column:
    """``c1 = v1 AND c2 = v2 ...``; nulls never match (SQL equality)."""
    preds = [F.col(k) == F.lit(v) for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def above(c: str, threshold: float) -> Column:
    """Strictly greater than."""
    return F.col(c) > F.lit(threshold)


def below(c: str, threshold: float) -> Column:
    """Strictly less than."""
    return F.col(c) < F.lit(threshold)


def within(c: str, lo, hi) -> Column:
    """Inclusive range (a chart viewport)."""
    return F.col(c).between(F.lit(lo), F.lit(hi))
