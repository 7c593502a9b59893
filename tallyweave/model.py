"""The survey bundle: responses, columns and questions as DataFrames keyed by survey.

responses(survey_id, response_id, included, cells ARRAY<STRING>)
    One row per response; `cells` follows the column order. Raw text is never rewritten.
columns(survey_id, col_idx, header, forced_kind)
questions(...)  see QUESTIONS below.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyweave.constants import SAFE_DELIMITERS

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
DERIVED = T.StructType(
    [T.StructField("type", _TEXT)]
    + [T.StructField(name, T.IntegerType()) for name in ("year_col", "month_col", "source_col")]
)
QUESTIONS = T.StructType(
    [
        T.StructField(name, dtype)
        for name, dtype in (
            ("survey_id", _TEXT),
            ("q_ord", T.IntegerType()),
            ("q_key", _TEXT),
            ("col_idx", T.IntegerType()),
            ("header", _TEXT),
            ("label", _TEXT),
            ("kind", _TEXT),
            ("chart", _TEXT),
            ("delimiters", _TEXTS),
            ("opt_order", _TEXT),
            ("preset_options", _TEXTS),
            ("option_aliases", T.MapType(_TEXT, _TEXT)),
            ("unit", _TEXT),
            ("selected", T.BooleanType()),
            ("identity", _TEXT),
            ("inferred", T.BooleanType()),
            ("profile_key", _TEXT),
            ("derived", DERIVED),
        )
    ]
)

KINDS = ("single", "multiple", "numeric", "free", "ignore")
DERIVATIONS = ("year-month", "work-days", "work-minutes")


@dataclass(frozen=True)
class Traits:
    """What the questions of a bundle use, so that plans carry only the needed branches."""

    kinds: frozenset[str] = frozenset(KINDS)
    derivations: frozenset[str] = frozenset(DERIVATIONS)
    aliases: bool = True
    presets: bool = True
    rows: int | None = None


@dataclass(frozen=True)
class Survey:
    responses: DataFrame
    questions: DataFrame
    columns: DataFrame | None = None
    warnings: DataFrame | None = None
    traits: Traits = field(default_factory=Traits)
    # Hand-written question rows, when the question table was made from them.
    rows: tuple[tuple, ...] | None = None

    def with_(self, **changes) -> "Survey":
        if "questions" in changes:
            changes.setdefault("rows", None)
        return replace(self, **changes)

    @property
    def spark(self) -> SparkSession:
        return self.responses.sparkSession


def question(
    survey_id: str,
    q_ord: int,
    q_key: str,
    kind: str,
    col_idx: int | None = None,
    *,
    label: str | None = None,
    header: str | None = None,
    chart: str | None = None,
    order: str = "count",
    presets: Iterable[str] | None = None,
    aliases: dict[str, str] | None = None,
    delimiters: Iterable[str] | None = None,
    unit: str | None = None,
    selected: bool = True,
    identity: str | None = None,
    inferred: bool = False,
    profile_key: str | None = None,
    derived: tuple | None = None,
) -> tuple:
    """One row of the question table, with the defaults a hand-written question needs."""
    charts = {"multiple": "hbar", "single": "bar", "numeric": "bar"}
    cut = list(delimiters) if delimiters is not None else list(SAFE_DELIMITERS)
    return (
        survey_id,
        q_ord,
        q_key,
        -1 if derived else (q_ord if col_idx is None else col_idx),
        header or label or q_key,
        label or q_key,
        kind,
        chart or charts.get(kind, "none"),
        cut if kind == "multiple" else [],
        order,
        list(presets) if presets else None,
        dict(aliases) if aliases else None,
        unit,
        selected,
        identity,
        inferred,
        profile_key,
        derived,
    )


def question_table(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, Traits]:
    """Question table from hand-written rows, with its traits known without a job."""
    traits = Traits(
        kinds=frozenset(r[6] for r in rows),
        derivations=frozenset(r[17][0] for r in rows if r[17]),
        aliases=any(r[11] for r in rows),
        presets=any(r[10] for r in rows),
        rows=len(rows),
    )
    if len(rows) > MAX_LITERAL_ROWS:
        return spark.createDataFrame(rows, QUESTIONS), traits
    # Literals keep the table inside the plan; no Python data source is involved.
    literal = F.array(*[_literal_row(r, QUESTIONS) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(literal)), traits


MAX_LITERAL_ROWS = 200


def _literal(value, dtype: T.DataType) -> Column:
    if value is not None and isinstance(dtype, T.ArrayType):
        made = F.array(*[F.lit(v) for v in value])
    elif value is not None and isinstance(dtype, T.MapType):
        made = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    elif value is not None and isinstance(dtype, T.StructType):
        made = F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, dtype)])
    else:
        made = F.lit(value)
    return made.cast(dtype)


def _literal_row(row: tuple, schema: T.StructType) -> Column:
    return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(row, schema)])


def traits_of(questions: DataFrame) -> Traits:
    """Measure traits of a question table with one small aggregate."""
    row = questions.agg(
        F.collect_set("kind").alias("kinds"),
        F.collect_set("derived.type").alias("derivations"),
        F.max(F.size(F.map_keys("option_aliases"))).alias("aliases"),
        F.max(F.size("preset_options")).alias("presets"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    return Traits(
        kinds=frozenset(row.kinds),
        derivations=frozenset(row.derivations),
        aliases=(row.aliases or 0) > 0,
        presets=(row.presets or 0) > 0,
        rows=row.rows,
    )


def table_responses(
    table: DataFrame,
    response_id: Column,
    cells: list[Column],
    survey_id: Column | str = "survey",
    included: Column | None = None,
) -> DataFrame:
    """View any wide table as survey responses; columns become string cells in order.

    `included` stays a plain condition so that it reaches the scan; NULL means excluded.
    """
    if isinstance(survey_id, str):
        # A constant would be folded out of partitioning and join keys, which turns per-survey
        # windows into single-task ones and key joins into nested loops; so it depends on the row,
        # at the price of one multiplication: 0 times the id chooses the only name there is.
        zero = F.coalesce(response_id.cast("bigint") * 0, F.lit(0))
        sid = F.elt((zero + 1).cast("int"), F.lit(survey_id))
    else:
        sid = survey_id
    return table.select(
        sid.alias("survey_id"),
        response_id.cast("bigint").alias("response_id"),
        (F.lit(True) if included is None else included).alias("included"),
        F.array(*[c.cast("string") for c in cells]).alias("cells"),
    )


def define_survey(
    spark: SparkSession, responses: DataFrame, questions: list[tuple]
) -> Survey:
    table, traits = question_table(spark, questions)
    return Survey(responses=responses, questions=table, traits=traits, rows=tuple(questions))
