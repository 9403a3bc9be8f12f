"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_date(c, source_type: T.DataType | None = None, fmt: str | None = None) -> Column:
    """Calendar date of a timestamp, or of a string (unparsable -> null).

    ``try_to_timestamp`` keeps a bad value from failing the whole job under
    ANSI mode; the row simply gets a null date.
    """
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(source_type, T.StringType):
        if fmt:
            return F.to_date(F.try_to_timestamp(col, F.lit(fmt)))
        return F.to_date(F.try_to_timestamp(col))
    return F.to_date(col)


def day_offset(end, start) -> Column:
    """Whole days from ``start`` to ``end`` as INT."""
    e = F.col(end) if isinstance(end, str) else end
    s = F.col(start) if isinstance(start, str) else start
    return F.datediff(e, s).cast("int")
