"""Respondent-based frequency tables for all questions of all surveys in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.numbers import percentage
from tallyweave.functions.text import natural_key, natural_order
from tallyweave.model import Survey
from tallyweave.operators.joins import dim_join
from tallyweave.operators.ranking import ranked
from tallyweave.operators.units import KEY, analysed, interpreted_units, with_dictionaries
from tallyweave.session import pin


def option_counts(units: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Respondents per option; the label shown is the spelling of the earliest respondent.

    Spellings are counted first with fixed-width buffers (hash aggregate), then merged per key.
    """
    spelled = (
        units.select(*keys, "n", "first_id", F.inline("options"))
        .groupBy(*keys, "key", "label")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )
    return spelled.groupBy(*keys, F.col("key").alias("opt_key")).agg(
        F.min_by("label", "first_id").alias("label"), F.sum("n").alias("count")
    )


def question_stats(units: DataFrame) -> DataFrame:
    """valid / blank respondents and total selections per question."""
    picks = F.when(F.col("options").isNotNull(), F.size("options")).otherwise(
        F.col("answered").cast("int")
    )
    return units.groupBy("survey_id", "q_key", "kind").agg(
        F.sum(F.when(F.col("answered"), F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(F.col("answered"), 0).otherwise(F.col("n"))).alias("blank"),
        F.sum(F.col("n") * picks).alias("total_selections"),
    )


def option_order(prefix: str = "") -> list[Column]:
    """Preset options first in preset order, then by count, then natural order.

    Works on the stored columns `_place`, `_natural`, `opt_order`, `count` and `label`.
    """
    c = lambda name: F.col(prefix + name)
    return [
        F.when(c("opt_order") == "preset", c("_place")).asc_nulls_last(),
        F.when(c("opt_order") != "natural", c("count")).desc(),
        *natural_order(c("label"), c("_natural")),
    ]


def rank_options(
    counts: DataFrame, questions: DataFrame, survey: Survey, keys: list[str] = KEY,
    at_most: int | None = None,
) -> DataFrame:
    """Add `rank` by each question's ordering rule; `at_most` bounds the number of options."""
    rules = with_dictionaries(questions, survey.traits).select(*KEY, "opt_order", "preset_keys")
    position = F.array_position("preset_keys", F.col("opt_key"))
    # Ranked inputs are pinned, so sort keys are stored and the preset list is dropped.
    placed = (
        dim_join(counts, rules, KEY, "opt_key", rows=survey.traits.rows)
        .withColumn("_place", F.when(position > 0, position))
        .withColumn("_natural", natural_key(F.col("label")))
        .drop("preset_keys")
    )
    return ranked(placed, keys, option_order(), at_most=at_most).drop("_place", "_natural", "opt_order")


def frequency(survey: Survey, units: DataFrame | None = None) -> DataFrame:
    """freq(survey_id, q_key, rank, opt_key, label, count, percentage) for choice questions."""
    questions = analysed(survey)
    units = pin(interpreted_units(survey)) if units is None else units
    valid = question_stats(units).select(*KEY, "valid")
    counts = dim_join(option_counts(units), valid, KEY, "opt_key", rows=survey.traits.rows)
    shares = counts.withColumn("percentage", percentage(F.col("count"), F.col("valid")))
    # Units are pinned: their options bound what has to be ranked, at the price of one small sum.
    listed = units.agg(F.sum(F.greatest(F.size("options"), F.lit(0)))).first()[0] or 0
    return rank_options(shares, questions, survey, at_most=listed).select(
        *KEY, "rank", "opt_key", "label", "count", "percentage"
    )


def survey_counters(responses: DataFrame) -> DataFrame:
    """total / included / excluded responses per survey; reads no cells."""
    return responses.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("included").alias("included"),
        (F.count(F.lit(1)) - F.count_if("included")).alias("excluded"),
    )


def all_question_stats(survey: Survey, units: DataFrame) -> DataFrame:
    """Statistics of every question; ignored ones have no answers, so all included are blank."""
    included = survey_counters(survey.responses).select("survey_id", "included")
    stats = question_stats(units).select(*KEY, "valid", "blank", "total_selections")
    return (
        survey.questions.select(*KEY, "q_ord", "kind")
        .join(included, "survey_id")
        .join(stats, KEY, "left")
        .select(
            *KEY,
            "q_ord",
            "kind",
            (F.col("kind") == "multiple").alias("multiple"),
            F.coalesce("valid", F.lit(0)).alias("valid"),
            F.coalesce("blank", "included").alias("blank"),
            F.coalesce("total_selections", F.lit(0)).alias("total_selections"),
        )
    )


def frequency_totals(freq: DataFrame) -> DataFrame:
    """Footer totals and number of options per question; multiple choice may exceed 100 %."""
    return freq.groupBy(*KEY).agg(
        F.sum("count").alias("count_sum"),
        (F.round(F.sum("percentage") * 100) / 100).alias("percentage_sum"),
        F.count(F.lit(1)).alias("options"),
    )


def records_and_respondents(table: DataFrame, keys: list[str], respondent: str) -> DataFrame:
    """Records next to distinct respondents; the unit of analysis stays the record.

    Distinct respondents are counted after a de-duplicating pre-aggregation, so a hot group
    is spread over its respondents.
    """
    per_person = table.groupBy(*keys, respondent).agg(F.count(F.lit(1)).alias("_n"))
    return per_person.groupBy(*keys).agg(
        F.sum("_n").alias("records"), F.count(respondent).alias("respondents")
    )
