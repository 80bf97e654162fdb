"""Free-text ages to months, as one vectorised function for Spark."""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The units' spellings, words for "never" and their code, the greatest age, days.
YEARS = r"(?:years?|yrs?|y\.?o\.?|y/o|y)"
MONTHS = r"(?:months?|moths?|mn?ths?|mons?|mos?|ms|mm|m)"
WEEKS = r"(?:weeks?|wks?|w)"
NEVER = re.compile(r"\b(?:never|unable|not\s+(?:yet|able)|can\s*not|can['’]?t|(?:has|does|did)(?:\s*n['’]?t|\s+not))\b")
ABOUT = re.compile(r"(?:(?:at|about|around|approximately|approx\.?|circa|c\.|almost|nearly|roughly|close\s+to|~)\s*)+(?=[\d½¼¾a])")
BOUND = re.compile(r"(?:[<>]=?|(?:less|more|greater)\s+than\b|(?:under|over|before|after|by|up\s+to)\b)\s*")
NEVER_CODE, GREATEST, DAYS_IN_MONTH = 888.0, 85.0, 30.4375
NUMBER = r"\d+(?:\.\d+)?"
_UNITS = {"y": 12.0, "m": 1.0, "w": 7 / DAYS_IN_MONTH}
_PART = re.compile(rf"({NUMBER})\s*(?:({YEARS})|({MONTHS})|({WEEKS}))(?![a-z])")
_GLYPHS = {"½": ".5", "¼": ".25", "¾": ".75"}


def _unit(m: re.Match) -> str:
    return "y" if m[2] else "m" if m[3] else "w"


def _single(text: str) -> tuple[float, str] | None:
    """The months of one age and its last unit (empty for a bare number)."""
    text = text.strip(" .,;+")
    if re.fullmatch(NUMBER, text):
        return float(text), ""
    if m := re.fullmatch(r"(\d+)\s*:\s*(\d+)\s*" + YEARS, text):
        return float(m[1]) * 12 + float(m[2]), "y"
    parts = list(_PART.finditer(text))
    rest = re.sub(r"\b(and|old|of age)\b|[\s.,;&]", "", _PART.sub("", text))
    units = [_unit(m) for m in parts]
    if not parts or rest or len(set(units)) != len(units):
        return None
    return sum(float(m[1]) * _UNITS[u] for m, u in zip(parts, units, strict=True)), units[-1]


def parse_age_months(value: str | None) -> float | None:
    """Months of an age as people write it; None if it isn't one.

    Ranges give their midpoint, bounds with a unit their end, words for 'not reached' their code; ages
    over the greatest are it.
    """
    if value is None:
        return None
    text = html.unescape(str(value)).lower().strip()
    if NEVER.search(text):
        return NEVER_CODE
    if re.fullmatch(r"(?:at )?birth", text):
        return 0.0
    text = re.sub(r"(\d)\s*([½¼¾])", lambda m: m[1] + _GLYPHS[m[2]], text)
    text = re.sub(r"(?<!\d)([½¼¾])", lambda m: "0" + _GLYPHS[m[1]], text)
    text = re.sub(r"(\d+)\s+(\d)/(\d)(?!\d)", lambda m: f"{int(m[1]) + int(m[2]) / int(m[3]):g}", text)
    if re.search(r"\d/\d", text) or re.search(r"\blost\b", text):
        return None
    text, bound = ABOUT.sub("", text, 1) if ABOUT.match(text) else text, BOUND.match(text)
    if bound:
        text = text[bound.end() :]
        text = ABOUT.sub("", text, 1) if ABOUT.match(text) else text
        if re.fullmatch(NUMBER, text):
            return None  # of a bound without a unit the scale is unknown
    text = re.sub(rf"^(?:by )?age ({NUMBER})$", r"\1 years", text)  # an age without a unit is in years
    text = re.sub(r"(\d)\+", r"\1", text)
    text = re.sub(r"^(?:age|=)\s*", "", text).strip()
    ends = re.split(r"\s*(?:-|–|\bto\b|\bor\b)\s*", text)
    found = None
    if len(ends) == 2 and all(ends):
        low, high = _single(ends[0]), _single(ends[1])
        if low and high:
            value_low = low[0] * _UNITS[high[1]] if not low[1] and high[1] else low[0]
            found = (value_low + high[0]) / 2
    elif len(ends) == 1 and (one := _single(text)):
        found = one[0]
    return None if found is None else min(found, GREATEST)


def age_months(c: Column) -> Column:
    """parse_age_months of a column, in Arrow batches."""

    def parse(s: pd.Series) -> pd.Series:
        known = {v: parse_age_months(v) for v in s.dropna().unique()}
        return s.map(lambda v: known.get(v, np.nan)).astype("float64")

    return F.pandas_udf(parse, "double")(c)
