"""Wide <-> long reshaping for chart-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
                 name: str = "variable", value: str = "value") -> DataFrame:
    """One row per (id, value column): ``unpivot`` (a narrow ``Expand``)."""
    vals = [c for c in df.columns if c not in ids] if values is None else list(values)
    return df.unpivot(list(ids), vals, name, value)


def long_to_wide(df: DataFrame, index: Sequence[str], key: str, value: str, keys: Sequence[str]) -> DataFrame:
    """One column per listed key.

    The key list is explicit, so the output schema is fixed and no extra
    job runs to discover distinct keys.  Each cell takes the single value
    of its (index, key); duplicates would be resolved by ``max``.
    """
    return df.groupBy(*index).pivot(key, list(keys)).agg(F.max(value))
