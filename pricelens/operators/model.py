"""Label scaling, stable splits, baseline predictors, trend forecasts.

* scaler: ``(mean, std_pop)`` fitted on the training split only, applied
  through one scalar subquery (no join, no cross product);
* split: md5 hash buckets of the listing key -- identical on any layout;
* baselines: mean scaled price per name; per-series least-squares trend of
  price on days, which also drives the day-grid forecast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.functions import stable_bucket
from pricelens.operators.joins import bounded_broadcast

SPLIT = "split"
TRAIN, VAL, TEST = "train", "val", "test"


SPLIT_BUCKETS = 10_000


def split_bounds(train_fraction: float = S.ORIGINAL_TRAIN_FRACTION) -> tuple[int, int]:
    """Bucket bounds (of ``SPLIT_BUCKETS``) for train/val/test: 0.8 then 0.8 again -> 64/16/20 %."""
    return round(SPLIT_BUCKETS * train_fraction * train_fraction), round(SPLIT_BUCKETS * train_fraction)


def add_split(df: DataFrame, key: str = S.URL, seed: int = S.ORIGINAL_SEED,
              train_fraction: float = S.ORIGINAL_TRAIN_FRACTION) -> DataFrame:
    """``split`` in train/val/test from a stable hash of ``key``.

    Unlike ``randomSplit`` the assignment does not move when the data is
    repartitioned or a task is retried.  Sizes are close to, not exactly,
    64/16/20 %.
    """
    t, v = split_bounds(train_fraction)
    b = stable_bucket(key, seed, SPLIT_BUCKETS)
    return df.withColumn(SPLIT, F.when(b < t, F.lit(TRAIN)).when(b < v, F.lit(VAL)).otherwise(F.lit(TEST)))


# --- splits of exact sizes -------------------------------------------------------

#: Buckets that a range of hashes is cut into in each round of the selection.
SELECT_BUCKETS = 1 << 12
_HASH = "_split_hash"


def exact_sizes(rows: int, train_fraction: float = S.ORIGINAL_TRAIN_FRACTION) -> tuple[int, int, int]:
    """(train, val, test) sizes: the part held out is rounded up, first the test rows, then the validation rows of what is left."""
    held = 1 - train_fraction
    test = math.ceil(round(rows * held, 9))
    val = math.ceil(round((rows - test) * held, 9))
    return rows - test - val, val, test


def kth_smallest(df: DataFrame, value: str, k: int, bits: int) -> tuple[int, int]:
    """(the k-th smallest of a column of whole numbers below ``2 ** bits``, how many are smaller); k from 1 on.

    Every round counts the values of one range by bucket and goes on with the
    bucket that holds the k-th: what reaches the driver is at most ``SELECT_BUCKETS`` counts.
    """
    low, size, below = 0, 1 << bits, 0
    while size > 1:
        width = max(1, size // SELECT_BUCKETS)  # a power of two, as the size is
        counts = (df.where((F.col(value) >= F.lit(low)) & (F.col(value) < F.lit(low + size)))
                  .groupBy(F.shiftright(F.col(value) - F.lit(low), width.bit_length() - 1).alias("_b"))
                  .agg(F.count(F.lit(1)).alias("_n")).collect())
        for r in sorted(counts, key=lambda r: r["_b"]):
            if below + r["_n"] >= k:
                low, size = low + r["_b"] * width, width
                break
            below += r["_n"]
        else:
            raise ValueError(f"there are fewer than {k} values")
    return low, below


def add_exact_split(df: DataFrame, key: str = S.URL, seed: int = S.ORIGINAL_SEED, train_fraction: float = S.ORIGINAL_TRAIN_FRACTION) -> DataFrame:
    """``split`` in train/val/test of exactly ``exact_sizes`` rows, by the order of a stable hash of ``key`` (ties by key).

    Neither partitioning nor retries move a row.  Rows that repeat a key stay
    in one split, the earlier one, so that a repeated key at a cut can make it larger.
    """
    k = F.col(key).cast("string")
    bits = 60
    hashed = df.withColumn(_HASH, F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(k, F.lit("")))), 1, bits // 4), 16, 10).cast("long"))
    hashes = hashed.select(_HASH, k.alias("_key"))
    n = hashes.count()
    train, val, _ = exact_sizes(n, train_fraction)
    split = F.lit(TEST)
    for name, last in ((VAL, train + val), (TRAIN, train)):
        if not last:
            continue
        cut, below = kth_smallest(hashes, _HASH, last, bits)
        # rows of the very hash at the cut: those of one key, but for collisions
        upto = hashes.where(F.col(_HASH) == cut).orderBy(F.asc_nulls_first("_key")).limit(last - below).agg(F.max("_key")).first()[0]
        within = (F.col(_HASH) < cut) | ((F.col(_HASH) == cut) & (F.coalesce(k, F.lit("")) <= F.lit(upto or "")))
        split = F.when(within, F.lit(name)).otherwise(split)
    return hashed.withColumn(SPLIT, split).drop(_HASH)


def fit_scaler(df: DataFrame, column: str = S.PRICE) -> DataFrame:
    """One row ``(mean, std, n)``; std is the population std (divides by n)."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))


def scaler_value(scaler: DataFrame) -> Column:
    """The fitted scaler as one struct-valued scalar subquery."""
    return scaler.select(F.struct("mean", "std")).scalar()


def scale(df: DataFrame, scaler: DataFrame | Column, column: str = S.PRICE, target: str = "price_z") -> DataFrame:
    sc = scaler_value(scaler) if isinstance(scaler, DataFrame) else scaler
    return df.withColumn(target, (F.col(column) - sc["mean"]) / sc["std"])


def unscale(df: DataFrame, scaler: DataFrame | Column, column: str, target: str) -> DataFrame:
    """Inverse of :func:`scale`: ``z * std + mean``."""
    sc = scaler_value(scaler) if isinstance(scaler, DataFrame) else scaler
    return df.withColumn(target, F.col(column) * sc["std"] + sc["mean"])


def fit_group_mean(train: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Baseline model: mean of ``value`` per ``key`` (partial aggregation)."""
    return train.groupBy(key).agg(F.avg(value).alias(target))


def predict_group_mean(df: DataFrame, model: DataFrame, key: str, target: str, default=0.0) -> DataFrame:
    """Attach the group mean; unseen keys get ``default`` (the training mean
    in scaled units is 0).  The model table grows with the number of keys,
    so the join strategy is left to the planner (AQE broadcasts it when small).
    """
    return (df.join(model, key, "left")
              .withColumn(target, F.coalesce(F.col(target), F.lit(default))))


def fit_trend(train: DataFrame, group_cols: Sequence[str], x: str, y: str) -> DataFrame:
    """Per-series least squares ``y = intercept + slope * x``.

    A series with one distinct x has no slope; it predicts its mean.
    """
    return (train.groupBy(*group_cols)
                 .agg(F.regr_slope(F.col(y), F.col(x)).alias("_slope"),
                      F.regr_intercept(F.col(y), F.col(x)).alias("_intercept"),
                      F.avg(y).alias("_mean"))
                 .select(*group_cols,
                         F.coalesce("_slope", F.lit(0.0)).alias("slope"),
                         F.coalesce("_intercept", "_mean").alias("intercept")))


def day_grid(prompts: DataFrame, days: tuple[int, int] = S.ORIGINAL_DAYS, day: str = "day") -> DataFrame:
    """Every prompt row repeated for each day of the half-open range.

    A generator (``explode(sequence)``) on the prompt rows, not a join: the
    work is split with the prompts, day-major order is irrelevant.
    """
    lo, hi = days
    return prompts.withColumn(day, F.explode(F.sequence(F.lit(int(lo)), F.lit(int(hi) - 1))))


def forecast_trend(grid: DataFrame, trend: DataFrame, group_cols: Sequence[str], day: str = "day",
                   target: str = "price", max_groups: int | None = None) -> DataFrame:
    """Trend value at each grid day.  ``trend`` has one row per series
    (broadcast when ``max_groups`` bounds the series count)."""
    return (grid.join(bounded_broadcast(trend, max_groups), list(group_cols))
                .withColumn(target, F.col("intercept") + F.col("slope") * F.col(day))
                .drop("intercept", "slope"))
