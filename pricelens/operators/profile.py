"""Profiles: null counts, frequencies, shares, group means, stage counts.

Each profile is one scan: many conditional aggregates in a single
``agg`` (partial aggregation map-side, one tiny final merge), reshaped to
long form afterwards on the one-row result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions import above, all_equal, text_length


def _long(wide: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """One-row wide aggregate -> ``(key, value)`` rows."""
    return wide.unpivot([], list(names), key, value)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, nulls)`` for every column, one pass."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _long(wide, cols, "column_name", "nulls")


def value_counts(df: DataFrame, column: str, value_name: str = "value", count_name: str = "n") -> DataFrame:
    """Frequency table of non-null values, most frequent first."""
    return (df.filter(F.col(column).isNotNull())
              .groupBy(F.col(column).alias(value_name))
              .agg(F.count(F.lit(1)).alias(count_name))
              .orderBy(F.desc(count_name), F.asc(value_name)))


def category_share(df: DataFrame, column: str, pct_name: str = "pct") -> DataFrame:
    """Count and percentage of rows per non-null category.

    The denominator is a scalar subquery over the (small) grouped result,
    not an unpartitioned window over the rows.
    """
    counts = (df.filter(F.col(column).isNotNull())
                .groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    total = counts.select(F.sum("n")).scalar()
    return counts.withColumn(pct_name, F.lit(100.0) * F.col("n") / total)


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "mean_price") -> DataFrame:
    """Mean of ``value`` per key tuple; rows with a null key are left out."""
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.avg(value).alias(name))


def stage_counts(df: DataFrame, conditions: Mapping[str, object], price_clip: float,
                 price: str = "price") -> DataFrame:
    """Rows left after each cleaning stage, from one scan of the raw rows."""
    has_price = F.col(price).isNotNull()
    in_cat = has_price & all_equal(conditions)
    kept = in_cat & above(price, price_clip)
    wide = df.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(has_price).alias("price_present"),
        F.count_if(in_cat).alias("category_match"),
        F.count_if(kept).alias("price_above_clip"),
    )
    out = _long(wide, ["raw", "price_present", "category_match", "price_above_clip"], "stage", "n_rows")
    order = F.create_map(*[x for i, s in enumerate(["raw", "price_present", "category_match", "price_above_clip"])
                           for x in (F.lit(s), F.lit(i))])
    return out.withColumn("step", order[F.col("stage")].cast("int"))


def column_profile(df: DataFrame) -> DataFrame:
    """``(column_name, data_type, non_null)`` -- schema plus one counting pass."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return (_long(wide, cols, "column_name", "non_null")
            .withColumn("data_type", types[F.col("column_name")]))


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct()


def avg_text_length(df: DataFrame, columns: Sequence[str], prefix: str = "avg_len_") -> DataFrame:
    """Mean character length per text column, one row."""
    return df.agg(*[F.avg(text_length(c)).alias(prefix + c) for c in columns])


def phrase_counts(df: DataFrame, column: str, phrases: Sequence[str]) -> DataFrame:
    """``(phrase, n)``: rows whose text contains each phrase (overlaps counted per phrase)."""
    wide = df.agg(*[F.count_if(F.col(column).contains(p)).alias(f"p{i}") for i, p in enumerate(phrases)])
    names = F.create_map(*[x for i, p in enumerate(phrases) for x in (F.lit(f"p{i}"), F.lit(p))])
    return (_long(wide, [f"p{i}" for i in range(len(phrases))], "slot", "n")
            .select(names[F.col("slot")].alias("phrase"), "n"))
