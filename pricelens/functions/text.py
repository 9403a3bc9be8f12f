"""String expressions: lower-casing, prompt building, phrase tagging, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and digits in any script; Java's \W is ASCII-only and would cut
# accented letters out of words.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_text(c) -> Column:
    """Unicode lower case (Polish and other accented letters included)."""
    return F.lower(_col(c))


def concat_space(*cols) -> Column:
    """Join texts with one space; null if any part is null (``a + ' ' + b``)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(_col(c))
    return F.concat(*parts)


def days_prompt(days, *texts) -> Column:
    """``"<n> days <text> [<text> ...]"``; null if any part is null."""
    return F.concat(_col(days).cast("string"), F.lit(" days "), concat_space(*texts))


def phrase_tag(c, ladder: Sequence[str]) -> Column:
    """First phrase of ``ladder`` contained in ``c`` (literal match), else null.

    The ladder is ordered most specific first, so "x pro max" is tested
    before "x pro" and "x".  One ``CASE WHEN`` chain, no Python per row.
    """
    if not ladder:
        return F.lit(None).cast("string")
    text = _col(c)
    expr = F.when(text.contains(ladder[0]), F.lit(ladder[0]))
    for phrase in ladder[1:]:
        expr = expr.when(text.contains(phrase), F.lit(phrase))
    return expr


def text_length(c) -> Column:
    """Length in characters."""
    return F.length(_col(c))


def token_array(c) -> Column:
    """Lower-cased word tokens (letters/digits runs), empty strings removed."""
    return F.filter(F.split(F.lower(_col(c)), TOKEN_SPLIT), lambda t: t != F.lit(""))
