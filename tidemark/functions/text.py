"""Text helpers as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.periods import ColumnOrName, _c

# Legal forms and filler dropped when names are matched, phrases first.
LEGAL_WORDS = (
    "NATIONAL ASSOCIATION", "N A", "NA", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LLC", "LTD", "THE", "AND",
    "HOLDING", "HOLDINGS", "GROUP", "FSB", "USA", "FINANCIAL", "SERVICES",
)
# Fixed value: shorter keys are too ambiguous to match on.
MIN_KEY = 4


def name_normalise(name: ColumnOrName, drop: tuple[str, ...] = LEGAL_WORDS) -> Column:
    """Upper case, & -> AND, punctuation out, legal words out, one space."""
    x = F.regexp_replace(F.upper(_c(name)), "&", " AND ")
    x = F.regexp_replace(x, "[^A-Z0-9 ]", " ")
    x = F.regexp_replace(x, r"\b(" + "|".join(drop) + r")\b", " ")
    return F.trim(F.regexp_replace(x, " +", " "))


def name_key(name: ColumnOrName, drop: tuple[str, ...] = LEGAL_WORDS, shortest: int = MIN_KEY) -> Column:
    """The normalised name, NULL if it is too short to match on."""
    x = name_normalise(name, drop)
    return F.when(F.length(x) >= shortest, x)


def geo_key(lat: ColumnOrName, lon: ColumnOrName, digits: int = 3) -> Column:
    """Rounded coordinate pair, about 100 m at three digits."""
    return F.concat_ws("_", F.round(_c(lat), digits).cast("string"), F.round(_c(lon), digits).cast("string"))


def grid_cell(lat: ColumnOrName, lon: ColumnOrName, step: float = 0.05) -> Column:
    """Integer cell of a regular grid."""
    return F.concat_ws(
        "_",
        F.round(_c(lat) / step).cast("long").cast("string"),
        F.round(_c(lon) / step).cast("long").cast("string"),
    )


def regex_extract_code(text: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """First match or NULL (an empty match is missing)."""
    return F.nullif(F.regexp_extract(_c(text), pattern, group), F.lit(""))


def keyword_flag(text: ColumnOrName, pattern: str) -> Column:
    return _c(text).rlike(pattern)


def sentence_filter(text: ColumnOrName, leak: str) -> Column:
    """Drop every sentence that matches ``leak``; the whole text is read."""
    parts = F.split(_c(text), r"(?<=[.!?])\s+")
    return F.array_join(F.filter(parts, lambda s: ~s.rlike(leak)), " ")
