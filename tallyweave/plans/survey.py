"""Whole-survey analysis: every statistic of every question from one pass over responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyweave.model import Survey
from tallyweave.operators import frequency as fr, numeric as nu
from tallyweave.operators.policy import free_text_samples
from tallyweave.operators.units import KEY, analysed, interpreted_units
from tallyweave.session import pin

GENERATOR = "tallyweave 1.0"
MAX_DOCUMENT_ITEMS = 1_000_000


@dataclass(frozen=True)
class Analysis:
    """Results keyed by survey and question; `items` holds options and bins alike."""

    survey: Survey
    counters: DataFrame
    stats: DataFrame
    items: DataFrame
    numeric: DataFrame
    samples: DataFrame


def analyze(survey: Survey) -> Analysis:
    """Analyse all selected questions. Raw responses are read once for counts (distinct cells
    are pinned) and once more for free-text samples when there are free questions."""
    questions = analysed(survey)
    units = pin(interpreted_units(survey))
    freq = fr.frequency(survey, units)
    items = freq.select(*KEY, "rank", "label", "count", "percentage")
    numeric = survey.spark.createDataFrame([], _NUMERIC)
    if "numeric" in survey.traits.kinds:
        values = pin(nu.value_counts(units))
        numeric = nu.numeric_summary(units, values)
        valid = fr.question_stats(units).select(*KEY, "valid")
        measure = questions.select(*KEY, "unit")
        bins = nu.histogram(values, measure, valid)
        items = items.unionByName(bins.select(*items.columns))
    samples = survey.spark.createDataFrame([], "survey_id string, q_key string, rank int, sample string")
    if "free" in survey.traits.kinds:
        samples = free_text_samples(survey)
    return Analysis(
        survey=survey,
        counters=fr.survey_counters(survey.responses),
        stats=fr.all_question_stats(survey, units),
        items=items,
        numeric=numeric,
        samples=samples,
    )


_NUMERIC = (
    "survey_id string, q_key string, n bigint, min double, max double, mean double, "
    "median double, p25 double, p75 double, sum double, unparsed bigint"
)


def analysis_documents(
    analysis: Analysis, source_names: DataFrame | None = None, generator: str = GENERATOR
) -> DataFrame:
    """(survey_id, document STRUCT): the nested result of each survey.

    A document is one survey's report: questions and their option tables, no raw answers
    beyond the bounded samples. A question with more than MAX_DOCUMENT_ITEMS options does not
    fit a nested document; the job then fails with a message and the tidy tables must be used.
    """
    in_order = lambda *fields: F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("v")))),
        lambda s: s["v"],
    )
    message = f"a question has more than {MAX_DOCUMENT_ITEMS} options; use the tidy tables"
    label = F.when(F.col("rank") > MAX_DOCUMENT_ITEMS, F.raise_error(message)).otherwise(F.col("label"))
    items = analysis.items.withColumn("label", label).groupBy(*KEY).agg(in_order("label", "count", "percentage").alias("items"))
    samples = analysis.samples.groupBy(*KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]
        ).alias("free_text_samples")
    )
    q = analysed(analysis.survey)
    numeric = analysis.numeric.join(q.select(*KEY, "unit"), KEY).select(
        *KEY, F.struct(*[c for c in analysis.numeric.columns if c not in KEY], "unit").alias("numeric")
    )
    asked = (
        q.select(*KEY, "q_ord", "label", "kind")
        .join(analysis.stats.select(*KEY, "multiple", "valid", "blank", "total_selections"), KEY)
        .join(items, KEY, "left")
        .join(numeric, KEY, "left")
        .join(samples, KEY, "left")
    )
    question = F.struct(
        F.col("q_key").alias("key"),
        F.col("label").alias("question"),
        "kind",
        "multiple",
        F.col("valid").alias("validResponses"),
        F.col("blank").alias("blankResponses"),
        F.col("total_selections").alias("totalSelections"),
        F.coalesce("items", F.array().cast("array<struct<label:string,count:bigint,percentage:double>>")).alias("items"),
        "numeric",
        F.when(F.col("kind") == "free", F.coalesce("free_text_samples", F.array().cast("array<string>"))).alias("freeTextSamples"),
    )
    nested = asked.groupBy("survey_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("q_ord", question.alias("question")))),
            lambda s: s["question"],
        ).alias("questions")
    )
    named = analysis.counters
    if source_names is not None:
        named = named.join(source_names, "survey_id", "left")
    else:
        named = named.withColumn("source_name", F.col("survey_id"))
    document = F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generatedAt"),
        F.lit(generator).alias("generator"),
        F.col("source_name").alias("sourceName"),
        F.col("total").alias("totalResponses"),
        F.col("included").alias("includedResponses"),
        F.col("excluded").alias("excludedResponses"),
        F.coalesce("questions", F.array().cast(nested.schema["questions"].dataType)).alias("questions"),
    )
    return named.join(nested, "survey_id", "left").select("survey_id", document.alias("document"))
