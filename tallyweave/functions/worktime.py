"""Values derived from other cells: year-month, work days and total work time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.constants import (
    APPROXIMATE_HEAD,
    APPROXIMATE_TAIL,
    DAYS_LABEL,
    DURATION_BINS,
    KANJI_DIGITS,
    MINUTES_LABEL,
    UNPARSED,
)
from tallyweave.functions.numbers import parse_number
from tallyweave.functions.text import let, norm_text

_SAFE_INT = 9007199254740991


def _integer(text: Column, pattern: str, group: int = 1) -> Column:
    """Integer captured by an anchored pattern; NULL without a match or beyond 2^53."""
    digits = F.regexp_extract(text, pattern, group)
    # Casting only real matches keeps failed casts, which are slow, out of the common path.
    number = let(digits, lambda d: F.when(d != "", d.try_cast("bigint")))
    return let(number, lambda n: F.when(n <= _SAFE_INT, n))


def _target(text: Column, label: str) -> Column:
    """Value after the first occurrence of a label, else a one-line cell."""
    rest = F.regexp_extract(text, f"{label}([^\\n]*)", 1)
    after = F.trim(F.regexp_replace(rest, "^[ :：=＝]+", ""))
    bare = F.when(text.contains("\n"), F.lit("")).otherwise(text)
    value = F.when(text.contains(label), after).otherwise(bare)
    value = F.regexp_replace(F.regexp_replace(value, APPROXIMATE_HEAD, ""), APPROXIMATE_TAIL, "")
    return F.trim(value)


def work_days(text: Column) -> Column:
    """Days stated in a normalised text, NULL when not stated beyond doubt."""

    def days(value: Column, labelled: Column) -> Column:
        kanji = F.regexp_extract(value, f"^([{KANJI_DIGITS}])日\\z", 1)
        found = F.coalesce(
            _integer(value, "^([0-9]+)日\\z"),
            F.when(kanji != "", F.position(kanji, F.lit(KANJI_DIGITS)).cast("bigint")),
            F.when(labelled, _integer(value, "^([0-9]+)\\z")),
        )
        return let(found, lambda d: F.when(d > 0, d))

    return let(
        text, lambda t: let(_target(t, DAYS_LABEL), lambda v: days(v, t.contains(DAYS_LABEL)))
    )


def work_minutes(text: Column) -> Column:
    """Total minutes stated in a normalised text, NULL when not stated beyond doubt."""

    def minutes(value: Column) -> Column:
        hm = "^([0-9]+)時間([0-9]+)分\\z"
        return F.coalesce(
            let(_integer(value, hm, 2), lambda m: F.when(m < 60, _integer(value, hm) * 60 + m)),
            _integer(value, "^([0-9]+)時間半\\z") * 60 + 30,
            _integer(value, "^([0-9]+)時間\\z") * 60,
            _integer(value, "^([0-9]+)分\\z"),
        )

    return let(text, lambda t: let(_target(t, MINUTES_LABEL), minutes))


def duration_label(minutes: Column) -> Column:
    label = None
    for upper, name in DURATION_BINS[:-1]:
        label = (F if label is None else label).when(minutes < upper, F.lit(name))
    return label.when(minutes.isNotNull(), F.lit(DURATION_BINS[-1][1]))


def _derived(text: Column, label) -> Column:
    """'' for an empty source cell (only '' is blank here), else the label or 'unparsed'."""
    return let(
        text,
        lambda t: F.when(t == "", F.lit("")).otherwise(F.coalesce(label(t), F.lit(UNPARSED))),
    )


def work_days_label(text: Column) -> Column:
    """Label from a normalised text."""
    return _derived(text, lambda t: F.concat(work_days(t).cast("string"), F.lit("日")))


def work_minutes_label(text: Column) -> Column:
    """Label from a normalised text."""
    return _derived(text, lambda t: let(work_minutes(t), duration_label))


def year_month_label(year: Column, month: Column) -> Column:
    """'YYYY-MM' from two numbers, '' when either is missing or the month is out of range."""

    def label(year: Column, month: Column) -> Column:
        whole = F.when(year == F.floor(year), year.cast("bigint").cast("string"))
        text = F.concat_ws(
            "-",
            F.coalesce(whole, year.cast("string")),
            F.lpad(month.cast("int").cast("string"), 2, "0"),
        )
        usable = year.isNotNull() & (month == F.floor(month)) & month.between(1, 12)
        return F.when(usable, text).otherwise(F.lit(""))

    def full(year: Column) -> Column:
        return F.when(year < 100, year + 2000).otherwise(year)

    pair = F.struct(year.alias("y"), month.alias("m"))
    return let(pair, lambda p: let(full(p["y"]), lambda y: label(y, p["m"])))


def work_days_cell(raw: Column) -> Column:
    return work_days_label(norm_text(raw))


def work_minutes_cell(raw: Column) -> Column:
    return work_minutes_label(norm_text(raw))


def year_month_cell(raw_year: Column, raw_month: Column) -> Column:
    return year_month_label(parse_number(raw_year), parse_number(raw_month))
