"""Numbers written in free text: extraction, rounding and display."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tallyweave.constants import (
    CALENDAR_DATE, HOUR_UNIT, HOURS_TEXT, MINUTES_TEXT, NUMERAL, RANGE_SEPARATORS, SCALES,
)
from tallyweave.functions.text import WS, let, nfkc

_SCALE_CLASS = "[" + "".join(SCALES) + "]"
# First numeral of the text followed by numerals of strictly smaller scale ("3万5000").
_SCALED = (
    "^[^0-9]*"
    + "".join(f"(?:{NUMERAL}{s})?" for s in SCALES)
    + f"(?:{NUMERAL}(?!{_SCALE_CLASS}))?"
)
_RANGE = (
    "(?s)^([^0-9]*[0-9].*?)(?:" + "|".join(RANGE_SEPARATORS) + ")(.*[0-9].*)\\z"
)


def tidy(c: Column) -> Column:
    """Round to 12 significant digits, which drops binary floating-point noise."""
    return F.format_string("%.11e", c).try_cast("double") + F.lit(0.0)


def _group(t: Column, pattern: str, index: int) -> Column:
    """Captured numeral as a double, 0 without a match; the leading zero avoids failed casts."""
    return F.concat(F.lit("0"), F.regexp_extract(t, pattern, index)).cast("double")


def _scaled(t: Column) -> Column:
    weights = [float(w) for w in SCALES.values()] + [1.0]
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + _group(t, _SCALED, i + 1) * F.lit(w)
    sign = F.when(t.rlike("^[-−][0-9]"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(t.rlike("[0-9]"), tidy(total * sign))


def _scalar(t: Column, unit: Column) -> Column:
    is_clock = unit.eqNullSafe(F.lit(HOUR_UNIT)) & (t.rlike(HOURS_TEXT) | t.rlike(MINUTES_TEXT))
    clock = tidy(_group(t, HOURS_TEXT, 1) + _group(t, MINUTES_TEXT, 1) / 60)
    return F.when(is_clock, clock).otherwise(_scaled(t))


def bare(text: Column) -> Column:
    """Drop white space and thousands commas from an NFKC text."""
    t = F.regexp_replace(text, WS + "+", "")
    return F.regexp_replace(t, "([0-9]),(?=[0-9]{3}(?![0-9]))", "$1")


def compact(c: Column) -> Column:
    """NFKC text without white space and without thousands commas."""
    return bare(nfkc(F.coalesce(c, F.lit(""))))


def _lent_scale(left: Column, right: Column) -> Column:
    """Scale written on the right end only ("1〜3万") also applies to the left end."""
    lent = F.regexp_extract(right, f"({_SCALE_CLASS})", 1)
    weight = F.when(left.rlike(_SCALE_CLASS), F.lit(1.0))
    for s, w in SCALES.items():
        weight = weight.when(lent == s, F.lit(float(w)))
    return weight.otherwise(F.lit(1.0))


def parse_compact(text: Column, unit: Column) -> Column:
    """Number in a compacted text; a range gives its midpoint, no digit gives NULL."""

    def midpoint(t: Column) -> Column:
        return let(
            F.regexp_extract(t, _RANGE, 1),
            lambda left: let(
                F.regexp_extract(t, _RANGE, 2),
                lambda right: tidy(
                    (_scalar(left, unit) * _lent_scale(left, right) + _scalar(right, unit)) / 2
                ),
            ),
        )

    def number(t: Column) -> Column:
        is_range = t.rlike(_RANGE) & ~t.contains("年") & ~t.rlike(CALENDAR_DATE)
        return F.when(is_range, midpoint(t)).otherwise(_scalar(t, unit))

    return let(text, number)


def parse_number(c: Column, unit: Column | None = None) -> Column:
    return parse_compact(compact(c), F.lit(None).cast("string") if unit is None else unit)


def percentage(count: Column, valid: Column) -> Column:
    """Share of `valid` in percent with two decimals, halves rounded up; 0 without answers."""
    return F.when(valid == 0, F.lit(0.0)).otherwise(
        F.floor(count / valid * 10000 + 0.5) / F.lit(100.0)
    )


@F.pandas_udf(T.StringType())
def fixed(value: pd.Series, decimals: pd.Series) -> pd.Series:
    """Fixed-point text from the exact binary value, halves away from zero (report edge only)."""

    def one(v, d):
        if v is None or pd.isna(v):
            return None
        text = str(Decimal(float(v)).quantize(Decimal(1).scaleb(-int(d)), ROUND_HALF_UP))
        return text.lstrip("-") if not text.strip("-0.") else text

    return pd.Series([one(v, d) for v, d in zip(value, decimals)], dtype=object)


def grouped(text: Column) -> Column:
    """Insert thousands commas into a plain number text."""
    return F.regexp_replace(text, "(?<=[0-9])(?=(?:[0-9]{3})+(?:\\.|\\z))(?<!\\.[0-9]{0,18})", ",")


def display_int(c: Column) -> Column:
    return grouped(c.cast("bigint").cast("string"))


def display(value: Column, decimals: Column) -> Column:
    """Grouped digits with the given number of decimals; whole numbers round half up."""
    whole = F.floor(value + 0.5).cast("bigint").cast("string")
    return grouped(F.when(decimals == 0, whole).otherwise(fixed(value, decimals)))
