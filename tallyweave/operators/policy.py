"""Which rows, questions and columns reach which output.

Overlays never change the source answers: exclusions act on rows, selection on questions and
visibility on identity columns. The table POLICY states the effect on each output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.constants import (
    FREE_SAMPLE_CHARS,
    FREE_SAMPLE_ROWS,
    IDENTITY_KINDS,
    LISTING_CHARS,
    LISTING_ROWS,
    VISIBLE_BY_DEFAULT,
)
from tallyweave.functions.text import (
    SEPARATOR,
    is_blank_norm,
    nfkc,
    norm_text,
    shorten_long,
    squeeze,
)
from tallyweave.model import Survey
from tallyweave.operators.joins import dim_join, is_small
from tallyweave.session import staged


@dataclass(frozen=True)
class OutputPolicy:
    excluded_rows: str
    unselected_questions: str
    identity_columns: str
    free_text: str


POLICY = {
    "frequency": OutputPolicy("dropped", "dropped", "never", "never"),
    "summary_csv": OutputPolicy("dropped", "dropped", "never", "never"),
    "analysis_json": OutputPolicy("dropped", "dropped", "never", "samples"),
    "summary_markdown": OutputPolicy("dropped", "dropped", "never", "never"),
    "crosstab": OutputPolicy("dropped", "kept", "never", "never"),
    "audit_csv": OutputPolicy("flagged", "kept", "by visibility", "kept"),
    "free_text_markdown": OutputPolicy("dropped", "kept", "never", "kept"),
}


# ---- rows ---------------------------------------------------------------------------------


def matches(needle: str, cells: str = "cells") -> Column:
    """Case-insensitive substring in any cell; an empty needle matches every response."""
    wanted = needle.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.exists(cells, lambda c: F.contains(F.lower(c), F.lit(wanted)))


def search(
    survey_responses: DataFrame,
    needle: str,
    hidden: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Responses with the needle in any cell, also in hidden identity cells.

    Pass `hidden` (survey_id, hidden ARRAY<INT>) to leave hidden cells out of the search.
    """
    if hidden is None:
        return survey_responses.where(matches(needle))
    df = dim_join(survey_responses, hidden, ["survey_id"], "response_id", rows=rows, how="left")
    seen = F.filter("cells", lambda c, i: ~F.array_contains(_or_none(F.col("hidden")), i))
    return df.withColumn("_seen", seen).where(matches(needle, "_seen")).drop("_seen", "hidden")


def _or_none(indexes: Column) -> Column:
    return F.coalesce(indexes, F.array().cast("array<int>"))


def set_included(responses: DataFrame, included: bool, matching: str | None = None) -> DataFrame:
    """Set the flag of all responses, or of those matching a search."""
    hit = F.lit(True) if matching is None else matches(matching)
    return responses.withColumn(
        "included", F.when(hit, F.lit(included)).otherwise(F.col("included"))
    )


def apply_exclusions(responses: DataFrame, overlay: DataFrame) -> DataFrame:
    """Apply overlay(survey_id, response_id, included), at most one row per response.

    A small overlay is broadcast, so responses are not shuffled for a few decisions; a large
    one joins on the response key, which is unique and therefore free of hot keys.
    """
    flags = overlay.select("survey_id", "response_id", F.col("included").alias("_flag"))
    if is_small(flags, OVERLAY_BROADCAST_ROWS):
        flags = F.broadcast(flags)
    return (
        responses.join(flags, ["survey_id", "response_id"], "left")
        .withColumn("included", F.coalesce("_flag", "included"))
        .select(*responses.columns)
    )


# Overlay rows are a survey name, an id and a flag.
OVERLAY_BROADCAST_ROWS = 200_000


def response_counters(responses: DataFrame, needle: str = "") -> DataFrame:
    """total / matched / included / excluded per survey."""
    return responses.groupBy("survey_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(matches(needle)).alias("matched"),
        F.count_if("included").alias("included"),
        (F.count(F.lit(1)) - F.count_if("included")).alias("excluded"),
    )


# ---- identity columns ---------------------------------------------------------------------


def identity_questions(questions: DataFrame) -> DataFrame:
    """First column of each identity kind, in the fixed display order."""
    place = F.array_position(F.array(*[F.lit(k) for k in IDENTITY_KINDS]), F.col("identity"))
    first = Window.partitionBy("survey_id", "identity").orderBy("q_ord")
    return (
        questions.where(F.col("identity").isNotNull() & (F.col("col_idx") >= 0))
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("survey_id", place.alias("position"), "identity", "col_idx", "q_key", "header", "label")
    )


def hidden_columns(
    questions: DataFrame, visible: tuple[str, ...] = VISIBLE_BY_DEFAULT
) -> DataFrame:
    """(survey_id, hidden ARRAY<INT>): identity columns whose kind is not visible."""
    hides = F.col("identity").isNotNull() & ~F.col("identity").isin(*visible) & (F.col("col_idx") >= 0)
    return questions.groupBy("survey_id").agg(
        F.array_sort(F.collect_list(F.when(hides, F.col("col_idx")))).alias("hidden")
    )


def visible_columns(columns: DataFrame, hidden: DataFrame) -> DataFrame:
    """Columns that listings and the audit export show, in source order."""
    gone = hidden.select("survey_id", F.explode("hidden").alias("col_idx"))
    return columns.join(gone, ["survey_id", "col_idx"], "left_anti")


def mask_cells(responses: DataFrame, hidden: DataFrame, rows: int | None = None) -> DataFrame:
    """Drop hidden cells from every response; the flag and the id are untouched."""
    df = dim_join(responses, hidden, ["survey_id"], "response_id", rows=rows, how="left")
    shown = F.filter("cells", lambda c, i: ~F.array_contains(_or_none(F.col("hidden")), i))
    return df.withColumn("cells", shown).drop("hidden")


# ---- listings -----------------------------------------------------------------------------


def shortened(cell: Column) -> Column:
    cut = F.concat(F.substring(cell, 1, LISTING_CHARS), F.lit("…"))
    return F.when(F.length(cell) > LISTING_CHARS, cut).otherwise(cell)


def listing_page(
    responses: DataFrame, hidden: DataFrame, needle: str = "", rows: int | None = None
) -> DataFrame:
    """First matching responses of each survey with shortened visible cells.

    The per-survey limit is taken before the shuffle in every task (window group limit).
    """
    first = Window.partitionBy("survey_id").orderBy("response_id")
    top = (
        search(responses, needle)
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= LISTING_ROWS)
    )
    return mask_cells(top, hidden, rows).select(
        "survey_id",
        (F.col("response_id") + 1).alias("no"),
        F.coalesce("included", F.lit(False)).alias("included"),
        F.transform("cells", shortened).alias("cells"),
    )


def free_text_entries(survey: Survey) -> DataFrame:
    """(survey_id, response_id, bodies): non-blank free answers of each included response.

    All free questions, selected or not; bodies are verbatim and stay in their row, so whole
    texts are never shuffled. Responses without a free answer are left out.
    """
    specs = (
        survey.questions.where("kind = 'free'")
        .groupBy("survey_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("q_ord", "q_key", "label", "col_idx", "selected"))).alias("specs")
        )
    )
    rows = survey.responses.where("included").select("survey_id", "response_id", "cells")
    joined = dim_join(rows, specs, ["survey_id"], "response_id", rows=survey.traits.rows)
    answers = F.transform(
        "specs",
        lambda s: F.struct(
            s["q_ord"].alias("q_ord"), s["q_key"].alias("q_key"), s["label"].alias("label"),
            s["selected"].alias("selected"),
            F.coalesce(F.get("cells", s["col_idx"]), F.lit("")).alias("body"),
        ),
    )
    df = staged(joined, _all=answers).select("survey_id", "response_id", "_all")
    # One normalisation call tests all of a response's answers.
    probe = lambda a: F.translate(shorten_long(a["body"]), SEPARATOR, "x")
    texts = nfkc(F.array_join(F.transform("_all", probe), SEPARATOR))
    blank = F.transform(F.split(texts, SEPARATOR), lambda t: is_blank_norm(squeeze(t)))
    df = df.withColumn("_blank", blank)
    bodies = F.filter("_all", lambda a, i: ~F.get("_blank", i))
    return staged(
        df, keep=lambda s: F.size(s["bodies"]) > 0, bodies=bodies
    ).select("survey_id", "response_id", "bodies")


def free_text_cells(survey: Survey) -> DataFrame:
    """(survey_id, response_id, q_ord, q_key, label, selected, body): one row per free answer."""
    return free_text_entries(survey).select("survey_id", "response_id", F.inline("bodies"))


def free_text_samples(survey: Survey) -> DataFrame:
    """First answers of each selected free question in row order, normalised and cut.

    Each task keeps its own first rows before the shuffle, so no question is gathered whole.
    """
    order = Window.partitionBy("survey_id", "q_key").orderBy("response_id")
    return (
        free_text_cells(survey)
        .where("selected")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= FREE_SAMPLE_ROWS)
        .select(
            "survey_id",
            "q_key",
            "rank",
            F.substring(norm_text(F.col("body")), 1, FREE_SAMPLE_CHARS).alias("sample"),
        )
    )
