"""Text expressions: tokens and their counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token has two letters or more, its parts are joined by single hyphens or apostrophes.
TOKEN = r"[A-Za-z]{2,}(?:[-'][A-Za-z]+)*"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; words broken by a hyphen at a line end are joined."""
    unified = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?<=[A-Za-z])-\s*\n\s*(?=[A-Za-z])", "")
    return F.transform(F.regexp_extract_all(unified, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")
