"""Label cleaning, classification and text assembly as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label codes, phrases kept by the consolidation, keyword order
# of the sex labels, and the characters Python treats as white space.
ETHNICITY_CODES = {
    "hispanic or latino": 1,
    "not hispanic or latino": 2,
    "information not provided by applicant in mail, internet, or telephone application": 3,
    "not applicable": 4,
    "no co-applicant": 5,
}
APPLICANT_DEFAULT_CODE = 3
CO_APPLICANT_DEFAULT_CODE = 5

RACE_PHRASES = (
    "white",
    "black or african american",
    "asian",
    "american indian or alaska native",
    "information not provided",
    "not applicable",
    "no co-applicant",
)

SEX_KEYWORDS = (
    ("female", "Female"),
    ("male", "Male"),
    ("not applicable", "Not applicable"),
    ("no co-applicant", "No co-applicant"),
)
SEX_DEFAULT = "Not provided"

BLANK = "\\s\\x1c-\\x1f"  # inside a class, with the (?U) flag
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(col: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(col, F.lit(BLANKS))


def normalised(col: Column) -> Column:
    """Trimmed lower case; missing stays missing."""
    return F.lower(stripped(col))


def normalised_or_null(col: Column) -> Column:
    """The normalised label; missing markers written as text become real nulls."""
    text = normalised(col)
    return F.nullif(F.nullif(text, F.lit("nan")), F.lit(""))


def request_flag(col: Column, compat: bool = False) -> Column:
    """1 where a preapproval was requested.

    ``compat`` also counts labels that say it was *not* requested, as a plain
    substring test does.
    """
    text = F.lower(F.coalesce(col, F.lit("unknown")))  # a search needs no trimming
    asked = text.contains("requested")
    if not compat:
        asked = asked & ~text.rlike(r"\bnot\s+requested\b")
    return F.when(asked, 1).otherwise(0)


def coded(col: Column, codes: Mapping[str, int], default: int, clean: bool = False) -> Column:
    """Integer code of a label, ``default`` for the rest; ``clean`` labels are normalised already."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col if clean else normalised(col)), F.lit(default))


def consolidated(
    col: Column, phrases: Sequence[str] = RACE_PHRASES, missing: str | None = None, compat: bool = False
) -> Column:
    """The trimmed label where it names one of ``phrases``, else ``Other``.

    ``compat`` looks for plain substrings, so "asian" is found in "caucasian".
    """
    text = col if missing is None else F.coalesce(col, F.lit(missing))
    any_phrase = "|".join(re.escape(p) for p in phrases)
    pattern = any_phrase if compat else rf"\b(?:{any_phrase})\b"
    return F.when(F.lower(text).rlike(pattern), stripped(text)).otherwise("Other")


def classified(
    col: Column, keywords: Sequence[tuple[str, str]] = SEX_KEYWORDS, default: str = SEX_DEFAULT
) -> Column:
    """The class of the first keyword found in the label, in the given order."""
    text = F.lower(col)
    chain = None
    for word, label in keywords:
        chain = (F if chain is None else chain).when(text.contains(word), F.lit(label))
    return chain.otherwise(F.lit(default))


def words(col: Column) -> Column:
    """White-space separated words, as Python's ``str.split()`` gives them."""
    return F.array_remove(F.split(col, f"(?U)[{BLANK}]+"), "")


def shown(col: Column, default: str = "unknown") -> Column:
    """A field as text, ``default`` where it is missing."""
    return F.coalesce(col.cast("string"), F.lit(default))
