"""Join-side choice: broadcast only what has a proven size bound.

A per-group table (quartiles, histogram starts, trend coefficients,
running-total offsets) has one row per group.  When the caller can bound
the number of groups from its parameters -- the sub-model ladder has a
fixed length, a range partitioner has ``spark.sql.shuffle.partitions``
output partitions -- the table is hinted for broadcast.  Otherwise the
join is left to the planner: with AQE on, the side is measured at runtime
and broadcast only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``,
else the join stays a shuffle (sort-merge) join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a broadcast side we accept on a proven bound (a few MB of keys and doubles).
BROADCAST_MAX_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """``F.broadcast(df)`` when ``max_rows`` is a bound under the limit, else ``df``."""
    if max_rows is not None and 0 <= max_rows <= BROADCAST_MAX_ROWS:
        return F.broadcast(df)
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    """Upper bound on the partitions a shuffle or range sort produces (AQE only coalesces)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
