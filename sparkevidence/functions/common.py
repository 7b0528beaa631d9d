"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(as_col(value), r"(?U)^\s+|\s+$", "")


def squeeze(value: Column | str) -> Column:
    """Collapse runs of whitespace to one blank and strip the ends."""
    return strip(F.regexp_replace(as_col(value), r"(?U)\s+", " "))


def first_match(value: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a pattern group; NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(as_col(value), pattern, group), F.lit(""))


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(value: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | value.contains(needle)
    return hit


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(as_col(value), F.lit(""))


def line(label: str, value: Column | str) -> Column:
    """``label + value``; NULL when the value is NULL or empty, so that concat_ws drops it."""
    return F.concat(F.lit(label), blank_to_null(value))


def let(value: Column, body) -> Column:
    """Use a computed value several times while computing it once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
