"""Regression error metrics as single-pass aggregates.

The original analysis computes mse, rmse, mae and r2 (and, in one place, SMAPE) on
collected arrays; here they are one ``agg`` over the scored rows, partial
aggregation on every task and a tiny final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def metric_columns(label, prediction) -> list[Column]:
    """``n, mse, rmse, mae, r2`` aggregate expressions.

    r2 = 1 - SSE / SST with SST = var_pop(y) * n; null when the label is
    constant (r2 undefined) instead of an ANSI division error.
    """
    y, p = _c(label), _c(prediction)
    err = p - y
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(sst > 0, F.lit(1.0) - sse / sst).alias("r2"),
    ]


def smape_column(label, prediction) -> Column:
    """Symmetric MAPE in percent (0..200); a term with ``|y| + |p| = 0`` counts as 0."""
    y, p = _c(label), _c(prediction)
    den = F.abs(y) + F.abs(p)
    term = F.when(den == 0, F.lit(0.0)).otherwise(F.lit(200.0) * F.abs(p - y) / den)
    return F.avg(term).alias("smape")


# Rounding per metric for stable comparison: errors in price units are large
# numbers (mse ~ 1e9), r2 is O(1).
DIGITS = {"mse": 2, "rmse": 6, "mae": 6, "r2": 9, "smape": 9}


def rounded(df: DataFrame, names: Sequence[str] = ("mse", "rmse", "mae", "r2")) -> DataFrame:
    return df.select(*[F.round(F.col(c), DIGITS.get(c, 6)).alias(c) if c in names else F.col(c)
                       for c in df.columns])


def regression_metrics(df: DataFrame, label: str, prediction: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``[group..., ] n, mse, rmse, mae, r2``."""
    agg = df.groupBy(*group_cols).agg(*metric_columns(label, prediction)) if group_cols else \
        df.agg(*metric_columns(label, prediction))
    return agg


def smape(df: DataFrame, label: str, prediction: str, group_cols: Sequence[str] = ()) -> DataFrame:
    agg = df.groupBy(*group_cols).agg(F.count(F.col(label)).alias("n"), smape_column(label, prediction)) \
        if group_cols else df.agg(F.count(F.col(label)).alias("n"), smape_column(label, prediction))
    return agg


def unscale_metrics(history: DataFrame, mean, std, mode: str = "correct") -> DataFrame:
    """Per-epoch metrics from scaled units to price units.

    ``correct``: mse * std^2, rmse * std, mae * std (r2 is scale free).
    ``affine``: x * std + mean on mse, mae and rmse -- what the original
    dashboard did; kept only to reproduce its published tables.
    """
    m, s = (F.lit(mean) if isinstance(mean, (int, float)) else mean), \
           (F.lit(std) if isinstance(std, (int, float)) else std)
    if mode == "correct":
        conv = {"mse": F.col("mse") * s * s, "mae": F.col("mae") * s, "rmse": F.col("rmse") * s}
    elif mode == "affine":
        conv = {c: F.col(c) * s + m for c in ("mse", "mae", "rmse")}
    else:
        raise ValueError(f"mode must be 'correct' or 'affine', not {mode!r}")
    return history.select(*[conv[c].alias(c) if c in conv else F.col(c) for c in history.columns])


def best_epoch(history: DataFrame, metric: str = "rmse", epoch: str = "epoch", lower_is_better: bool = True,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """The epoch with the best ``metric`` (per run).  Ties: the earliest epoch."""
    key = F.struct(F.col(metric) if lower_is_better else -F.col(metric), F.col(epoch))
    agg = [F.min_by(F.col(epoch), key).alias(epoch), F.min_by(F.col(metric), key).alias(metric)]
    return history.groupBy(*group_cols).agg(*agg) if group_cols else history.agg(*agg)
