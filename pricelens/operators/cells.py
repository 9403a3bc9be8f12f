"""Quantiles from stored counts: kept once per group, merged for any choice of groups.

Values are counted in cells whose width grows with the value: cell ``i`` of the positive
side holds ``growth ** i <= v < growth ** (i + 1)``, the negative side mirrors it, zero has its own.
A cell keeps its row count, sum and smallest and largest value.  Cells add up, so the
counts per (tag, day) answer for any range of days without another look at the rows,
and new days are appended.

Error: an answer comes with ``<name>_low`` and ``<name>_high``, the smallest and largest value
of its cell, between which the exact quantile lies.  They are less than ``growth - 1`` (2 ``accuracy`` /
(1 - ``accuracy``)) of the value apart; the rank of an answer is off by less than the rows of its cell.
A group has at most one cell per ``growth`` step of its value range, whatever its row count.
Null and NaN values are left out; infinities fall in the outermost cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.005
#: Farther out than any double's cell, so that signed cells keep the order of values.
_ZERO_AT = 1 << 24
_FARTHEST = float(1 << 23)


def growth_of(accuracy: float) -> float:
    return (1.0 + accuracy) / (1.0 - accuracy)


def count_cells(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``keys..., cell, n, total, first, last``: the state to store, one partial/final aggregate."""
    v = F.col(value).cast("double")
    place = F.floor(F.greatest(F.least(F.ln(F.abs(v)) / F.lit(math.log(growth_of(accuracy))), F.lit(_FARTHEST)), F.lit(-_FARTHEST)))
    cell = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (place + _ZERO_AT)).cast("bigint")
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, cell.alias("cell"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("first"), F.max(v).alias("last")))


def merge_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of coarser groups (or of several stores put together)."""
    return cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))


def box_from_cells(cells: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75), names: Sequence[str] = ("q1", "median", "q3")) -> DataFrame:
    """``keys..., n, min, max, mean`` (exact) and each quantile (type 7) with its bounds.

    Inside a cell values are taken as evenly spaced from its smallest to its largest.
    """
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a group's cells, not its rows
    whole = Window.partitionBy(*keys)
    ranked = merge_cells(cells, keys).select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_under"), F.sum("n").over(whole).alias("_n"))
    step = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    picked, out = [], []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        at = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            here = (rank >= F.col("_under")) & (rank < F.col("_under") + F.col("n"))
            spaced = F.col("first") + (rank - F.col("_under")) * step
            picked += [F.max(F.when(here, what)).alias(f"_{kind}{side}{i}") for kind, what in (("v", spaced), ("l", F.col("first")), ("h", F.col("last")))]
        part = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        part = part - F.floor(part)
        for kind, label in (("v", name), ("l", f"{name}_low"), ("h", f"{name}_high")):
            low, high = F.col(f"_{kind}a{i}"), F.col(f"_{kind}b{i}")
            out.append(F.when(part == 0, low).otherwise(low + part * (high - low)).alias(label))
    told = ranked.groupBy(*keys, "_n").agg(F.min("first").alias("min"), F.max("last").alias("max"), F.sum("total").alias("_total"), *picked)
    return told.select(*keys, F.col("_n").alias("n"), "min", "max", (F.col("_total") / F.col("_n")).alias("mean"), *out)
