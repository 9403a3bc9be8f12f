"""Cleaning and exploration frames: ``DataFrame -> DataFrame`` steps.

Every step is a narrow transformation except :func:`add_days_passed`, whose
global minimum is a scalar subquery (one partial/final aggregate, its single
value handed to every task) -- no window over the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens import schema as S
from pricelens.functions import (
    above, all_equal, as_date, below, concat_space, day_offset, days_prompt, lower_text, phrase_tag, within,
)


def drop_null(df: DataFrame, columns: Sequence[str] = (S.PRICE,)) -> DataFrame:
    """Rows with a null in any of ``columns`` are dropped."""
    return df.na.drop(subset=list(columns))


def add_date(df: DataFrame, source: str = S.ADDED_AT, target: str = S.DATE, fmt: str | None = None) -> DataFrame:
    """Calendar date of the listing time."""
    return df.withColumn(target, as_date(source, df.schema[source].dataType, fmt))


def filter_categories(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Keep rows equal to every ``column: value`` pair."""
    return df.filter(all_equal(conditions))


def drop_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*(S.ORIGINAL_DROP if columns is None else columns))


def clip_price(df: DataFrame, clip: float, column: str = S.PRICE) -> DataFrame:
    """Keep prices strictly above ``clip``."""
    return df.filter(above(column, clip))


def below_price(df: DataFrame, clip: float, column: str = S.PRICE) -> DataFrame:
    """Audit slice: prices strictly below ``clip`` (exactly ``clip`` is in neither side)."""
    return df.filter(below(column, clip))


def lowercase(df: DataFrame, columns: Sequence[str] = (S.NAME, S.DESCRIPTION)) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, lower_text(c))
    return df


def add_days_passed(df: DataFrame, date: str = S.DATE, target: str = S.DAYS_PASSED) -> DataFrame:
    """Whole days since the earliest date of ``df`` itself (after its filters)."""
    first = df.select(F.min(date)).scalar()
    return df.withColumn(target, day_offset(F.col(date), first))


def add_prompts(df: DataFrame) -> DataFrame:
    """``"<n> days <name>"`` and ``"<n> days <name> <description>"``."""
    return (df.withColumn(S.DAYS_PASSED_NAME, days_prompt(S.DAYS_PASSED, S.NAME))
              .withColumn(S.DAYS_PASSED_NAME_DESC, days_prompt(S.DAYS_PASSED, S.NAME, S.DESCRIPTION)))


def base_filtered(df: DataFrame, conditions: Mapping[str, object], columns_to_drop: Sequence[str] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Null price out, date added, categories filtered, columns dropped."""
    drop = [c for c in (S.ORIGINAL_DROP if columns_to_drop is None else columns_to_drop) if c not in keep]
    out = drop_null(df)
    out = add_date(out)
    out = filter_categories(out, conditions)
    return drop_columns(out, drop)


def preprocess(df: DataFrame, conditions: Mapping[str, object] | None = None,
               columns_to_drop: Sequence[str] | None = None, price_clip: float = S.ORIGINAL_PRICE_CLIP,
               keep: Sequence[str] = ()) -> DataFrame:
    """Model input: ``price`` and the two day-prefixed prompts.

    Order matters and follows the original: the earliest date is taken
    after the category filter and the price clip.  ``keep`` retains extra
    columns (e.g. ``url`` as a stable key for splitting).
    """
    conditions = S.ORIGINAL_FILTERS if conditions is None else conditions
    out = base_filtered(df, conditions, columns_to_drop, keep)
    out = clip_price(out, price_clip)
    out = lowercase(out)
    out = add_days_passed(out)
    out = add_prompts(out)
    return out.select(*keep, S.PRICE, S.DAYS_PASSED_NAME, S.DAYS_PASSED_NAME_DESC)


def prepared(df: DataFrame, conditions: Mapping[str, object] | None = None, price_clip: float = S.ORIGINAL_PRICE_CLIP,
             ladder: Sequence[str] | None = None) -> DataFrame:
    """Everything a modelling or trend job needs, one row per listing.

    ``url, price, name, description, date, days_passed, phone_model`` plus the
    two prompts; same filters and order as :func:`preprocess`.
    """
    conditions = S.ORIGINAL_FILTERS if conditions is None else conditions
    ladder = S.ORIGINAL_LADDER if ladder is None else ladder
    out = base_filtered(df, conditions, None, keep=(S.URL,))
    out = clip_price(out, price_clip)
    out = lowercase(out)
    out = add_days_passed(out)
    out = add_prompts(out)
    return out.withColumn(S.PHONE_MODEL, phrase_tag(concat_space(S.NAME, S.DESCRIPTION), ladder))


def low_price_audit(df: DataFrame, conditions: Mapping[str, object] | None = None,
                    price_clip: float = S.ORIGINAL_PRICE_CLIP) -> DataFrame:
    """Rejected cheap rows (accessories, services) for inspection."""
    conditions = S.ORIGINAL_FILTERS if conditions is None else conditions
    return below_price(base_filtered(df, conditions), price_clip)


def add_concatenated(df: DataFrame, target: str = S.CONCATENATED_DESCRIPTION) -> DataFrame:
    """Lower-case name and description, joined by a space."""
    return lowercase(df).withColumn(target, concat_space(S.NAME, S.DESCRIPTION))


def add_phone_model(df: DataFrame, ladder: Sequence[str], source: str = S.CONCATENATED_DESCRIPTION,
                    target: str = S.PHONE_MODEL) -> DataFrame:
    return df.withColumn(target, phrase_tag(source, ladder))


def explore_frame(df: DataFrame, conditions: Mapping[str, object] | None = None,
                  price_clip: float = S.ORIGINAL_PRICE_CLIP, ladder: Sequence[str] | None = None) -> DataFrame:
    """``price, date, phone_model`` of the wanted listings (tag null when no phrase matches)."""
    conditions = S.ORIGINAL_FILTERS if conditions is None else conditions
    ladder = S.ORIGINAL_LADDER if ladder is None else ladder
    out = add_concatenated(df)
    out = drop_null(out)
    out = add_date(out)
    out = filter_categories(out, conditions)
    out = clip_price(out, price_clip)
    out = add_phone_model(out, ladder)
    return out.select(S.PRICE, S.DATE, S.PHONE_MODEL)


def one_group(df: DataFrame, value: str, column: str = S.PHONE_MODEL) -> DataFrame:
    """Rows of one group, e.g. one sub-model."""
    return df.filter(F.col(column) == F.lit(value))


def viewport(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Chart viewport: keep rows whose ``column`` lies in ``[lo, hi]``."""
    return df.filter(within(column, lo, hi))


def flag_extrapolated(df: DataFrame, horizon, day: str = "day", target: str = "extrapolated") -> DataFrame:
    """True for days after the last observed day (``horizon``: value or Column)."""
    h = horizon if not isinstance(horizon, (int, float)) else F.lit(horizon)
    return df.withColumn(target, F.col(day) > h)
