"""Price distributions per group: box statistics, histogram, Gaussian KDE.

All are partial/final aggregates over the rows themselves: a hot group costs
map-side combines rather than a single task holding its rows, and no
distinct value is shuffled.  Per-group tables (quartiles, starts, bandwidths)
have one row a group and are broadcast only where ``max_groups`` bounds them.
Nothing is rounded here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens import schema as S
from pricelens.operators.joins import bounded_broadcast
from pricelens.operators.ranking import exact_quantiles


def _present(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    out = df.filter(F.col(value).isNotNull())
    for g in group_cols:
        out = out.filter(F.col(g).isNotNull())
    return out


def box_stats(df: DataFrame, group_cols: Sequence[str], value: str, max_groups: int | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends and outlier count per group.

    Quartiles are exact, linear interpolation (the charting default).
    """
    g = list(group_cols)
    rows = _present(df, g, value)
    quart = exact_quantiles(rows, g, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], max_groups)
    spread = F.col("q3") - F.col("q1")
    fences = quart.select(*g, "q1", "median", "q3", (F.col("q1") - 1.5 * spread).alias("lower_fence"), (F.col("q3") + 1.5 * spread).alias("upper_fence"))
    v = F.col(value)
    inside_lo, inside_hi = v >= F.col("lower_fence"), v <= F.col("upper_fence")
    return (rows.join(bounded_broadcast(fences, max_groups), g)
                .groupBy(*g, "q1", "median", "q3", "lower_fence", "upper_fence")
                .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                     F.min(F.when(inside_lo, v)).alias("whisker_low"), F.max(F.when(inside_hi, v)).alias("whisker_high"),
                     F.count_if(~(inside_lo & inside_hi)).alias("n_outliers"))
                .select(*g, "n", "min", "max", "mean", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "n_outliers"))


def histogram(df: DataFrame, group_cols: Sequence[str], value: str, width: float = S.ORIGINAL_BIN_WIDTH,
              max_groups: int | None = None) -> DataFrame:
    """Density-normalised histogram per group; bins start at the group minimum.

    ``density = n / (group_rows * width)``, so each group's bars integrate to 1.
    """
    g = list(group_cols)
    rows = _present(df, g, value)
    starts = rows.groupBy(*g).agg(F.min(value).alias("_start"), F.count(F.lit(1)).alias("_total"))
    idx = F.floor((F.col(value) - F.col("_start")) / F.lit(float(width))).cast("int")
    binned = (rows.join(bounded_broadcast(starts, max_groups), g)
                  .groupBy(*g, idx.alias("bin_index"), "_start", "_total").agg(F.count(F.lit(1)).alias("n")))
    return binned.select(
        *g, "bin_index",
        (F.col("_start") + F.col("bin_index") * F.lit(float(width))).alias("bin_start"), "n",
        (F.col("n") / (F.col("_total") * F.lit(float(width)))).alias("density"))


#: Kernel values computed at a time in a task (rows of a piece times grid points).
_KDE_CELLS = 1 << 20


def kde(df: DataFrame, group_cols: Sequence[str], value: str, points: int = 500,
        max_groups: int | None = None) -> DataFrame:
    """Gaussian KDE per group on ``points`` grid positions from min to max.

    Bandwidth is Scott's rule, ``h = stddev_samp * n^(-1/5)``; groups of one
    row or one value have none and are left out.  Each task adds up, for every
    group it meets, a vector of ``points`` kernel sums over Arrow batches and
    hands on that vector alone: groups x points rows a task, none a value.
    """
    g = list(group_cols)
    rows = _present(df, g, value)
    stats = (rows.groupBy(*g)
                 .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                      F.stddev_samp(value).alias("_sd"))
                 .filter((F.col("_n") >= 2) & (F.col("_sd") > 0))
                 .withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))))
    known = rows.join(bounded_broadcast(stats, max_groups), g).select(*g, F.col(value).cast("double").alias("_v"), "_n", "_lo", "_hi", "_h")
    out = T.StructType([known.schema[c] for c in [*g, "_n", "_lo", "_hi", "_h"]] + [T.StructField("grid_index", T.IntegerType()), T.StructField("_s", T.DoubleType())])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        steps = np.arange(points)
        for frame in batches:
            for key, part in frame.groupby([*g, "_n", "_lo", "_hi", "_h"], sort=False):
                n_, lo, hi, h = key[len(g):]
                x = lo + (steps * (hi - lo)) / float(points)
                total = sums.setdefault(key, np.zeros(points))
                values, weight = np.unique(part["_v"].to_numpy(), return_counts=True)
                block = max(1, _KDE_CELLS // points)
                for a in range(0, len(values), block):
                    z = (x[None, :] - values[a:a + block, None]) / h
                    total += weight[a:a + block] @ np.exp(-0.5 * z * z)
        for key, total in sums.items():
            fixed = dict(zip([*g, "_n", "_lo", "_hi", "_h"], key, strict=True))
            yield pd.DataFrame({**{c: [v] * points for c, v in fixed.items()}, "grid_index": steps.astype(np.int32), "_s": total})

    per_task = known.mapInPandas(add_up, out)
    x = F.col("_lo") + (F.col("grid_index") * (F.col("_hi") - F.col("_lo"))) / F.lit(float(points))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi))
    return (per_task.groupBy(*g, "_n", "_lo", "_hi", "_h", "grid_index").agg(F.sum("_s").alias("_s"))
                    .select(*g, "grid_index", x.alias("x"), (F.col("_s") / norm).alias("density")))


#: Bins of a binned density for each of its grid points, and how many bandwidths its kernel reaches.
KDE_BINS_PER_POINT = 4
KDE_REACH = 6


def binned_kde(df: DataFrame, group_cols: Sequence[str], value: str, points: int = 500, max_groups: int | None = None,
               bins_per_point: int = KDE_BINS_PER_POINT, reach: int = KDE_REACH) -> DataFrame:
    """``kde`` from bin weights: the cost follows the bins, not rows times points.

    A row's weight is shared by the two bin edges beside it in proportion
    to how near they are, in one aggregate; each edge then adds its kernel to the grid points within
    ``reach`` bandwidths.  With edges ``d`` apart and a bandwidth of ``h``, sharing moves
    a kernel by at most ``d * d / 8`` times its largest second derivative and the cut tail is ``exp(-reach ** 2 / 2)``, so the density is
    off by at most ``(d * d / (8 * h * h) + exp(-reach ** 2 / 2)) / (h * sqrt(2 * pi))``.
    """
    g = list(group_cols)
    rows = _present(df, g, value)
    stats = (rows.groupBy(*g)
                 .agg(F.count(F.lit(1)).alias("_n"), F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.stddev_samp(value).alias("_sd"))
                 .filter((F.col("_n") >= 2) & (F.col("_sd") > 0))
                 .withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))))
    bins = points * bins_per_point
    place = (F.col(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))
    low = F.least(F.floor(place), F.lit(bins - 1))
    keys = [*g, "_n", "_lo", "_hi", "_h"]
    shared = (rows.join(bounded_broadcast(stats, max_groups), g).select(*keys, place.alias("_p"), low.alias("_b"))
                  .groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col("_p") - F.col("_b")).alias("_up")))
    edge = F.explode(F.array(F.struct(F.col("_b").alias("b"), (F.col("_c") - F.col("_up")).alias("w")), F.struct((F.col("_b") + 1).alias("b"), F.col("_up").alias("w"))))
    edges = shared.select(*keys, edge.alias("_e")).groupBy(*keys, F.col("_e.b").alias("_b")).agg(F.sum("_e.w").alias("_w"))
    # grid points (every bins_per_point-th edge) that an edge's kernel reaches
    span = F.lit(float(reach)) * F.col("_h") / (F.col("_hi") - F.col("_lo")) * F.lit(float(points))
    at = F.col("_b") / F.lit(float(bins_per_point))
    first, last = F.greatest(F.ceil(at - span), F.lit(0)), F.least(F.floor(at + span), F.lit(points - 1))
    x = F.col("_lo") + (F.col("grid_index") * (F.col("_hi") - F.col("_lo"))) / F.lit(float(points))
    v = F.col("_lo") + (F.col("_b") * (F.col("_hi") - F.col("_lo"))) / F.lit(float(bins))
    z = (x - v) / F.col("_h")
    spread = edges.where(first <= last).select(*keys, "_b", "_w", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("grid_index"))
    summed = spread.groupBy(*keys, "grid_index").agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    # points that no edge reaches have density 0
    grid = stats.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_index"))
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi))
    told = grid.join(summed.select(*g, "grid_index", "_s"), [*g, "grid_index"], "left")
    return told.select(*g, "grid_index", x.alias("x"), (F.coalesce("_s", F.lit(0.0)) / norm).alias("density"))
