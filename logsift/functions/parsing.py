"""Parsers of lists that were written as text, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"


def token_list(s: Column) -> Column:
    """[a, b] without brackets and blanks, split at commas; nothing left: an empty list."""
    bare = F.regexp_replace(s, r"[\[\] ]", "")
    return F.when(bare == "", F.array().cast(_NONE)).otherwise(F.split(bare, ","))


def event_list(s: Column) -> Column:
    """A list that begins with [: parts trimmed, quotes stripped, empty ones dropped; anything else is an empty list."""
    inner = F.regexp_replace(F.trim(s), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    return F.when(F.trim(s).startswith("["), F.filter(parts, lambda x: x != "")).otherwise(F.array().cast(_NONE))


def float_list(s: Column) -> Column:
    """Numbers of a list; one bad value makes the whole list empty."""
    parts = F.transform(F.split(F.regexp_replace(s, r"[\[\] ]", ""), ","), lambda x: x.try_cast("double"))
    return F.when(F.exists(parts, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(parts)


def soft_threshold(x: Column, tau: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - tau, F.lit(0.0))
