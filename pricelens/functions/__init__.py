"""Column-expression builders: pure ``Column -> Column`` helpers, all JVM-side."""

from pricelens.functions.text import (  # noqa: F401
    concat_space, days_prompt, lower_text, phrase_tag, text_length, token_array,
)
from pricelens.functions.dates import as_date, day_offset  # noqa: F401
from pricelens.functions.predicates import all_equal, above, below, within  # noqa: F401
from pricelens.functions.hashing import stable_bucket  # noqa: F401
