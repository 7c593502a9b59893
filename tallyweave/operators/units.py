"""Answer units: one row per question and distinct raw cell, then its interpretation.

Everything a frequency table, a summary or a histogram needs depends on a cell's text only,
so raw cells are counted first (map-side combined, one shuffle) and each distinct text is
normalised, split or parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.answers import joined_text, options_of, values_of
from tallyweave.functions.numbers import bare, parse_compact
from tallyweave.functions.text import (
    SEPARATOR,
    is_blank_norm,
    key_of,
    nfkc,
    protect,
    restore,
    shorten_long,
    squeeze,
)
from tallyweave.functions.worktime import work_days_label, work_minutes_label, year_month_label
from tallyweave.model import Survey, Traits
from tallyweave.operators.joins import dim_join
from tallyweave.session import staged

KEY = ["survey_id", "q_key"]


def analysed(survey: Survey) -> DataFrame:
    """Questions that reach the statistics: selected and not ignored."""
    return survey.questions.where((F.col("kind") != "ignore") & F.col("selected"))


def cell_sources(question: DataFrame) -> DataFrame:
    """Per question, the one or two columns its text comes from."""
    d = F.col("derived.type")
    return question.select(
        "survey_id",
        "q_key",
        "kind",
        F.when(d == "year-month", F.col("derived.year_col"))
        .when(d.isNotNull(), F.col("derived.source_col"))
        .otherwise(F.col("col_idx"))
        .alias("a"),
        F.when(d == "year-month", F.col("derived.month_col")).alias("b"),
    )


def _picked(key: Column, is_free: Column, first: Column, second: Column) -> Column:
    raw = F.coalesce(first, F.lit(""))
    # Free text is only counted: long bodies shrink before they are grouped.
    body = F.when(is_free, shorten_long(raw)).otherwise(raw)
    return F.struct(key.alias("q_key"), body.alias("raw"), second.alias("raw2"))


def source_columns(row: tuple) -> tuple[int, int | None]:
    """Source columns of a hand-written question row, as in `cell_sources`."""
    col_idx, derived = row[3], row[17]
    if not derived:
        return col_idx, None
    return (derived[1], derived[2]) if derived[0] == "year-month" else (derived[3], None)


def answer_cells(
    survey: Survey, questions: DataFrame, rows: list[tuple] | None = None
) -> DataFrame:
    """(survey_id, response_id, q_key, raw, raw2) of included responses, one row per question.

    Question specs travel as one array per survey, so responses are joined once, not per cell.
    `rows` are the questions when all are hand-written for one survey: then no join is needed
    and only the columns they name are read.
    """
    responses = survey.responses.where("included").select("survey_id", "response_id", "cells")
    if rows:
        used = sorted({i for r in rows for i in source_columns(r) if i is not None})
        own = responses.where(F.col("survey_id") == rows[0][0]).select(
            "survey_id", "response_id", *[F.get("cells", F.lit(i)).alias(f"_{i}") for i in used]
        )
        cells = []
        for r in rows:
            a, b = source_columns(r)
            second = F.lit(None).cast("string") if b is None else F.coalesce(f"_{b}", F.lit(""))
            cells.append(_picked(F.lit(r[2]), F.lit(r[6] == "free"), F.col(f"_{a}"), second))
        return own.select("survey_id", "response_id", F.inline(F.array(*cells)))
    specs = (
        cell_sources(questions)
        .groupBy("survey_id")
        .agg(F.collect_list(F.struct("q_key", "kind", "a", "b")).alias("specs"))
    )
    joined = dim_join(responses, specs, ["survey_id"], "response_id", rows=survey.traits.rows)

    def picked(s: Column) -> Column:
        second = F.when(s["b"].isNotNull(), F.coalesce(F.get("cells", s["b"]), F.lit("")))
        return _picked(s["q_key"], s["kind"] == "free", F.get("cells", s["a"]), second)

    return joined.select("survey_id", "response_id", F.inline(F.transform("specs", picked)))


def answer_units(
    survey: Survey, questions: DataFrame, rows: list[tuple] | None = None
) -> DataFrame:
    """Distinct cells with their number of respondents and the first respondent."""
    return (
        answer_cells(survey, questions, rows)
        .groupBy("survey_id", "q_key", "raw", "raw2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("response_id").alias("first_id"))
    )


def _keys_of_all(texts: Column) -> Column:
    """Grouping keys of an array of texts with one normalisation call."""
    joined = F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), protect), SEPARATOR)
    parts = F.transform(F.split(nfkc(joined), SEPARATOR), lambda p: key_of(squeeze(restore(p))))
    return F.when(F.size(texts) > 0, parts)


def with_dictionaries(questions: DataFrame, traits: Traits) -> DataFrame:
    """Add `alias_index` (key -> option) and `preset_keys` to the question table."""
    if traits.aliases:
        targets = F.map_values("option_aliases")
        keyed = questions.withColumns(
            {"_from": _keys_of_all(F.map_keys("option_aliases")), "_to": _keys_of_all(targets)}
        )
        entries = F.transform(
            F.col("_from"),
            lambda k, i: F.struct(
                k.alias("key"),
                F.struct(
                    F.get("_to", i).alias("key"), F.get(targets, i).alias("label")
                ).alias("value"),
            ),
        )
        first = F.filter(
            F.col("_entries"),
            lambda e, i: (e["key"] != "") & (F.array_position("_from", e["key"]) == i + 1),
        )
        questions = (
            keyed.withColumn("_entries", entries)
            .withColumn("alias_index", F.map_from_entries(first))
            .drop("_from", "_to", "_entries")
        )
    else:
        questions = questions.withColumn(
            "alias_index", F.lit(None).cast("map<string,struct<key:string,label:string>>")
        )
    presets = _keys_of_all(F.col("preset_options")) if traits.presets else F.lit(None)
    return questions.withColumn("preset_keys", presets.cast("array<string>"))


def _derived_values(traits: Traits, text: Column, text2: Column, derivation: Column) -> Column:
    """Values of derived questions, built from NFKC source texts."""
    no_unit = F.lit(None).cast("string")
    build = {
        "year-month": lambda: year_month_label(
            parse_compact(bare(text), no_unit), parse_compact(bare(text2), no_unit)
        ),
        "work-days": lambda: work_days_label(squeeze(text)),
        "work-minutes": lambda: work_minutes_label(squeeze(text)),
    }
    label = F
    for name in sorted(traits.derivations):
        label = label.when(derivation == name, build[name]())
    return F.filter(F.array(label), lambda v: ~is_blank_norm(v))


def interpret(df: DataFrame, traits: Traits) -> DataFrame:
    """Add `options`, `num` and `answered` for the cell in `raw` / `raw2`.

    The question's `kind`, `delimiters`, `alias_index`, `unit` and `derived` must be present.
    Each distinct cell is normalised by one call, whatever its kind.
    """
    kind, derivation = F.col("kind"), F.col("derived.type")
    if "multiple" in traits.kinds:
        multiple = kind == "multiple"
        text = joined_text(F.col("raw"), F.col("delimiters"), multiple)
        unwraps = multiple & (F.size("delimiters") > 0)
    else:
        text, unwraps = nfkc(protect(F.col("raw"))), F.lit(False)
    texts = {"_text": text}
    if "year-month" in traits.derivations:
        texts["_text2"] = nfkc(F.coalesce("raw2", F.lit("")))
    df = df.withColumns(texts)
    values = values_of(F.col("_text"), unwraps)
    if traits.derivations:
        derived = _derived_values(traits, restore(F.col("_text")), F.col("_text2"), derivation)
        values = F.when(derivation.isNull(), values).otherwise(derived)
    df = staged(df, _values=values)

    optional = kind.isin("single", "multiple")
    alias_index = F.col("alias_index") if traits.aliases else F.lit(None)
    number = F.lit(None).cast("double")
    if "numeric" in traits.kinds:
        first = F.get("_values", F.lit(0))
        number = F.when(kind == "numeric", parse_compact(bare(first), F.col("unit")))
    options = F.when(optional, options_of(F.col("_values"), alias_index))
    df = staged(df, options=options, num=number)
    answered = F.when(optional, F.size("options")).otherwise(F.size("_values")) > 0
    return df.withColumn("answered", answered).drop("_text", "_text2", "_values")


def interpreted_units(
    survey: Survey, questions: DataFrame | None = None, kinds: tuple[str, ...] | None = None
) -> DataFrame:
    """Answer units with options, numbers and an answered flag.

    Selected, not ignored questions by default; `kinds` asks for all questions of some kinds.
    """
    rows = None
    if questions is None:
        if kinds is None:
            questions = analysed(survey)
            wanted = lambda r: r[6] != "ignore" and r[13]
        else:
            questions = survey.questions.where(F.col("kind").isin(*kinds))
            wanted = lambda r: r[6] in kinds
        rows = [r for r in survey.rows or () if wanted(r)]
        if len({r[0] for r in survey.rows or ()}) != 1:
            rows = None
    units = answer_units(survey, questions, rows)
    return with_meaning(units, questions, survey.traits).select(
        "survey_id", "q_key", "kind", "raw", "n", "first_id", "options", "num", "answered"
    )


def with_meaning(units: DataFrame, questions: DataFrame, traits: Traits) -> DataFrame:
    """Units with their question's rules and what their cells mean."""
    spec = with_dictionaries(questions, traits).select(
        "survey_id", "q_key", "kind", "delimiters", "unit", "derived", "alias_index"
    )
    return interpret(dim_join(units, spec, KEY, "raw", rows=traits.rows), traits)


def fractional_year_warnings(units: DataFrame, questions: DataFrame) -> DataFrame:
    """(survey_id, code, n): responses whose year cell was a range and gave a fractional year."""
    derived = questions.where(F.col("derived.type") == "year-month").select(*KEY)
    fractional = F.get("options", F.lit(0))["label"].rlike("^[0-9]+\\.[0-9]+-[0-9]{2}\\z")
    return (
        units.join(derived, KEY, "left_semi")
        .where(fractional)
        .groupBy("survey_id")
        .agg(F.lit("fractional-year").alias("code"), F.sum("n").alias("n"))
    )
