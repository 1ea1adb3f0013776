"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose lower case of the upper case is not their case folding, with stand-ins (private use) or foldings.
_KEPT = {"\u0131": "\ue000"}
_FOLDED = {"\u1e9e": "ss"}


def case_fold(c: Column) -> Column:
    """Case folding: equal for spellings that differ in case only, with sharp s as ss."""
    for a, b in _FOLDED.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    for a, b in _KEPT.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    # What stands between the two keeps the optimizer from dropping the inner one.
    c = F.upper(c)
    for a, b in _KEPT.items():
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.lower(c)


def normal_spelling(c: Column) -> Column:
    """Folded case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(case_fold(c), r"(?U)[\s\x1c-\x1f]+", " "))


def normal_path(c: Column) -> Column:
    """Forward slashes, and no leading dots and slashes (as characters)."""
    return F.ltrim(F.translate(c, "\\", "/"), F.lit("./"))
