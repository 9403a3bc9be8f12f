"""Exact ranks and quantiles without one-task-per-group windows.

A ``Window.partitionBy(g).orderBy(v)`` puts every row of a group into one
task; a group holding a third of the data would then run on one core.

* ``global_rank`` sorts globally (the range partitioner splits anything) and
  writes the sorted frame once with each row's place in its partition; the
  per-partition counts and the rows are then both read from that one copy, so
  no result depends on a sort being run, or reused, twice alike.
* ``exact_quantiles`` never sorts: each wanted rank has an interval of values,
  rows in it are counted in fixed-width buckets (a partial/final aggregate),
  and the interval shrinks to the bucket that holds the rank until it is one
  value.  What moves is a bucket count, never a group's rows.

Group keys may be null: all joins on them are null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.operators.joins import bounded_broadcast, shuffle_partitions
from pricelens.session import landed

#: Buckets an interval is cut into in each round.
BUCKETS = 1024
_ROW_BITS = 33  # of monotonically_increasing_id: the place in a partition


def global_rank(df: DataFrame, order_cols: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order over the whole DataFrame, distributed.

    The order must be total for the ranks to be the same on every run.
    """
    at = F.col("_at")
    placed = landed(df.orderBy(*order_cols).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    offsets = bounded_broadcast(offsets, shuffle_partitions(df.sparkSession))
    return (placed.withColumn("_part", part).join(offsets, "_part")
                  .withColumn(name, F.col("_before") + at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1)
                  .drop("_at", "_part", "_before"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys (true when there are none)."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], max_groups: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7) per group; null and NaN values are left out.

    Every round reads the rows once, counts those in the open intervals by
    bucket and keeps, for each wanted rank, the smallest and largest value of
    the bucket that holds it.  Intervals shrink ``BUCKETS``-fold a round (or to
    the values there are), so a few rounds end on single values.  The interval
    table has at most ``2 * len(probs)`` rows a group.
    """
    g = list(group_cols)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*g, F.col(value).alias("_v"))
    ranks = sorted({p for p in probs})
    positions = [(F.col("_n") - 1).cast("double") * F.lit(float(p)) for p in ranks]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in positions])))
    stats = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    targets = landed(stats.select(*g, "_n", F.explode(wanted).alias("_rank"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi"), "quantiles")
    bound = None if max_groups is None else max_groups * 2 * len(ranks)
    while not targets.filter("_lo < _hi").isEmpty():
        span = targets.filter("_lo < _hi").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(g)], F.col("_lo").alias("_a"), F.col("_hi").alias("_b")).distinct()
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(g)], F.col("_v").between(F.col("_a"), F.col("_b")))
        width = F.col("_b").cast("double") - F.col("_a").cast("double")
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_a")).cast("double") / width * BUCKETS)).cast("int")
        counted = (rows.join(bounded_broadcast(span, bound), on)
                       .groupBy(*g, "_a", "_b", bucket.alias("_bucket"))
                       .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last")))
        before = Window.partitionBy(*g, "_a", "_b").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
        cells = counted.withColumn("_under", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        cells = cells.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(g)], "_a", "_b", "_c", "_first", "_last", "_under")
        here = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(g)], (F.col("_lo") == F.col("_a")) & (F.col("_hi") == F.col("_b")))
        found = F.col("_rank") - F.col("_below") - F.col("_under")
        narrowed = (targets.filter("_lo < _hi").join(cells, here).filter((found >= 0) & (found < F.col("_c")))
                           .select(*g, "_n", "_rank", (F.col("_below") + F.col("_under")).alias("_below"), F.col("_first").alias("_lo"), F.col("_last").alias("_hi")))
        targets = landed(targets.filter("_lo = _hi").unionByName(narrowed), "quantiles")
    at = [(F.col("_n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    value_at = [(F.max(F.when(F.col("_rank") == F.floor(p), F.col("_lo"))), F.max(F.when(F.col("_rank") == F.ceil(p), F.col("_lo")))) for p in at]
    per = targets.groupBy(*g, "_n").agg(*[x for i, (a, b) in enumerate(value_at) for x in (a.alias(f"_lo{i}"), b.alias(f"_hi{i}"))])
    out = [(F.col(f"_lo{i}") + (p - F.floor(p)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm) for i, (p, nm) in enumerate(zip(at, names, strict=True))]
    return per.select(*g, F.col("_n").alias("n"), *out)
