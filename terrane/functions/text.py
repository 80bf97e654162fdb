"""Text normalisation that the catalogue and the cohort readers share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(c: Column) -> Column:
    """A cell as a string: null is empty, carriage returns go, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r", ""))


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def key_of(c: Column) -> Column:
    """Lower case letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def truthy(c: Column) -> Column:
    return ~F.lower(F.trim(c)).isin("", "0", "0.0", "no", "false", "n")


def value_levels(coding: Column) -> Column:
    """How many lines of a value coding hold '='."""
    return F.size(F.filter(F.split(F.coalesce(coding, F.lit("")), "\n"), lambda x: x.contains("=")))


def codes(c: Column) -> Column:
    """Coded values on one line; an empty list is blank."""
    whole = F.trim(F.coalesce(c, F.lit("")))
    return F.when(whole.isin("", "[]", "{}"), "").otherwise(F.regexp_replace(whole, r"\s*\n\s*", "; "))


def one_line(c: Column, width: int = 60) -> Column:
    """White space collapsed, cut to a width with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def tokens(c: Column) -> Column:
    """Lower case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda x: x != "")
