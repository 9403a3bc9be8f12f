"""Robust LOWESS trend per series.

The charting default: local linear fits over the ``frac`` nearest points
with tricube weights, then ``iterations`` robustifying rounds with bisquare
weights of the residuals (6 x median absolute residual).

Scale: rows are first folded to one point per ``(series, x)`` by a
partial/final aggregate, so a series has at most one point per distinct x
(days: bounded by the calendar span, not by the row count).  Each series is
then smoothed in one ``applyInPandas`` task with numpy, in blocks of
target points so memory stays ``block x n``.  Pairs are never materialised
in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schema as S

BLOCK = 512


def lowess_fit(x: np.ndarray, y: np.ndarray, frac: tuple[int, int] = S.ORIGINAL_LOWESS_FRAC,
               iterations: int = S.ORIGINAL_LOWESS_ITERATIONS) -> np.ndarray:
    """Smoothed values at ``x`` (distinct, any order) -- the charting library rule set.

    k = floor(n * a / b) nearest points (self included); h = distance of the
    k-th nearest; weight (1 - (d/h)^3)^3 for d < h, else 0; the local line
    is used when at least two points carry weight, else the weighted mean;
    with no weight at all, the point's own y.
    """
    n = len(x)
    if n == 0:
        return np.array([], dtype=float)
    k = max(1, (n * frac[0]) // frac[1])
    robust = np.ones(n)
    fit = y.astype(float).copy()
    for it in range(iterations + 1):
        for s in range(0, n, BLOCK):
            xi = x[s:s + BLOCK]
            d = np.abs(x[None, :] - xi[:, None])
            h = np.partition(d, k - 1, axis=1)[:, k - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                u = d / h[:, None]
            t = 1.0 - u * u * u
            tri = np.where(d < h[:, None], t * t * t, 0.0)
            w = tri * robust[None, :]
            sw = w.sum(axis=1)
            cnt = (w > 0).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                mx = (w * x[None, :]).sum(axis=1) / sw
                my = (w * y[None, :]).sum(axis=1) / sw
                dx = x[None, :] - mx[:, None]
                sxx = (w * dx * dx).sum(axis=1)
                sxy = (w * dx * (y[None, :] - my[:, None])).sum(axis=1)
                line = my + (sxy / sxx) * (xi - mx)
            out = np.where(cnt >= 2, line, my)
            out = np.where(sw > 0, out, y[s:s + BLOCK])
            fit[s:s + BLOCK] = out
        if it == iterations:
            break
        resid = y - fit
        m = np.median(np.abs(resid))
        if m == 0:
            robust = np.ones(n)
        else:
            r = resid / (6.0 * m)
            b = 1.0 - r * r
            robust = np.where(np.abs(r) < 1.0, b * b, 0.0)
    return fit


def lowess(df: DataFrame, series: Sequence[str], x: str, y: str, target: str = "trend",
           frac: tuple[int, int] = S.ORIGINAL_LOWESS_FRAC,
           iterations: int = S.ORIGINAL_LOWESS_ITERATIONS) -> DataFrame:
    """``series..., x, y, trend``: one point per (series, x), y = mean of the rows there."""
    keys = list(series)
    points = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
                .groupBy(*keys, x).agg(F.avg(y).alias(y)))
    out_fields = [points.schema[c] for c in keys] + [
        T.StructField(x, points.schema[x].dataType, True),
        T.StructField(y, T.DoubleType(), True),
        T.StructField(target, T.DoubleType(), True),
    ]
    schema = T.StructType(out_fields)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x, kind="mergesort").reset_index(drop=True)
        xs = pdf[x].to_numpy(dtype=float)
        ys = pdf[y].to_numpy(dtype=float)
        pdf[target] = lowess_fit(xs, ys, frac, iterations)
        return pdf[[f.name for f in schema.fields]]

    return points.groupBy(*keys).applyInPandas(smooth, schema)
