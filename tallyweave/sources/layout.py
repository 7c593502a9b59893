"""Headers of raw tables and folding of paired-column platform exports.

Such an export writes a choice question as two columns, a numbered code column and a label
column with an empty header, and repeats the pair per option for multiple choice. The column
plan is worked out on headers only; responses are then folded in place, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.constants import BLANK_TOKENS, MANAGEMENT_HEADERS, NUMBERED_HEADER, UNNAMED_COLUMN
from tallyweave.functions.text import HIDDEN, INLINE_WS, SEPARATOR, norm_text, protect, restore
from tallyweave.operators.joins import dim_join
from tallyweave.operators.questions import unique_names
from tallyweave.session import pin, staged

# Between the texts of several questions; protected text has no such pair of characters.
BESIDE = HIDDEN + "1"


def named_columns(raw_columns: DataFrame) -> DataFrame:
    """columns(survey_id, col_idx, header, is_empty, renamed) from (survey_id, col_idx, header_raw).

    Headers are normalised, empty ones are named by position, repeats get a number.
    """
    named = raw_columns.withColumn("_norm", norm_text(F.col("header_raw")))
    named = named.withColumn("is_empty", F.col("_norm") == "").withColumn(
        "_named",
        F.when(
            F.col("is_empty"), F.concat(F.lit(UNNAMED_COLUMN), (F.col("col_idx") + 1).cast("string"))
        ).otherwise(F.col("_norm")),
    )
    return unique_names(named.drop("_norm"), "_named", "header").select(
        "survey_id", "col_idx", "header_raw", "header", "is_empty",
        (F.col("header") != F.col("_named")).alias("renamed"),
    )


def parse_headers(columns: DataFrame, header: str = "header") -> DataFrame:
    """Add number, branch and text of numbered question headers; NULL for other headers."""
    df = columns.withColumn("header_norm", norm_text(F.col(header)))
    group = lambda i: F.regexp_extract("header_norm", NUMBERED_HEADER, i)
    question = (group(1) != "") & (group(3) != "")
    return df.withColumns(
        {
            "number": F.when(question, group(1)),
            "branch": F.when(question & (group(2) != ""), group(2)),
            "question_text": F.when(question, F.trim(group(3))),
        }
    )


def detect_layout(columns: DataFrame) -> DataFrame:
    """(survey_id, paired): all management headers present, and a branch-numbered header or a
    numbered header directly followed by an empty one."""
    df = parse_headers(columns)
    # Rows are sorted as a few small numbers, however long their headers are.
    df = df.select(
        "survey_id",
        "col_idx",
        "is_empty",
        F.array_position(F.array(*map(F.lit, MANAGEMENT_HEADERS)), F.col("header_norm")).cast("tinyint").alias("_managed"),
        F.col("number").isNotNull().alias("_numbered"),
        F.col("branch").isNotNull().alias("_branched"),
    )
    nxt = F.lead("is_empty").over(Window.partitionBy("survey_id").orderBy("col_idx"))
    df = df.withColumn("_next", F.coalesce(nxt, F.lit(False)))
    flags = [F.max(F.col("_managed") == i + 1).alias(f"_m{i}") for i in range(len(MANAGEMENT_HEADERS))]
    is_pair = F.col("_numbered") & (F.col("_branched") | F.col("_next"))
    found = df.groupBy("survey_id").agg(*flags, F.max(is_pair).alias("_pair"))
    paired = F.col("_pair")
    for i in range(len(MANAGEMENT_HEADERS)):
        paired = paired & F.col(f"_m{i}")
    return found.select("survey_id", paired.alias("paired"))


def column_plan(columns: DataFrame) -> DataFrame:
    """(survey_id, col_idx, header, forced_kind, multiple, sources): logical columns of paired
    exports, in order of their first source column."""
    order = Window.partitionBy("survey_id").orderBy("col_idx")
    df = parse_headers(columns)
    df = df.withColumns(
        {
            "_next_empty": F.coalesce(F.lead("is_empty").over(order), F.lit(False)),
            "_managed": F.col("header_norm").isin(*MANAGEMENT_HEADERS),
        }
    )
    question = F.col("number").isNotNull() & ~F.col("_managed")
    asked = df.where(question).withColumn(
        "_label_col", F.col("col_idx") + F.col("_next_empty").cast("int")
    )
    first = lambda c: F.min_by(c, "col_idx")
    groups = asked.groupBy("survey_id", "number", F.col("branch").isNotNull().alias("_branched")).agg(
        F.min("col_idx").alias("_at"),
        F.concat(F.col("number"), F.lit(". "), first("question_text")).alias("header"),
        (F.col("_branched") | (F.count(F.lit(1)) > 1)).alias("multiple"),
        first("_next_empty").alias("_choice"),
        F.array_sort(F.collect_list("_label_col")).alias("sources"),
    )
    # Empty headers are label columns or strays; every other column stays on its own.
    others = df.where(~question & ~F.col("is_empty")).select(
        "survey_id",
        F.col("col_idx").alias("_at"),
        F.col("header_norm").alias("header"),
        F.lit(False).alias("multiple"),
        F.lit(False).alias("_choice"),
        F.array("col_idx").alias("sources"),
    )
    everything = groups.select(others.columns).unionByName(others)
    forced = F.when(F.col("multiple"), "multiple").when(F.col("_choice"), "single")
    position = F.row_number().over(Window.partitionBy("survey_id").orderBy("_at")) - 1
    return everything.select(
        "survey_id",
        position.alias("col_idx"),
        "header",
        forced.alias("forced_kind"),
        "multiple",
        "sources",
    )


def _label_folder():
    # Everything the helper needs is local, so it travels to executors by value.
    separator, hidden, beside, blanks = SEPARATOR, HIDDEN, BESIDE, frozenset(("", *BLANK_TOKENS))
    inline, around = re.compile(INLINE_WS), re.compile(" *\\n *")

    def label(text: str) -> str:
        """As `norm_text` of a protected label."""
        text = text.replace(hidden + "0", separator).replace(hidden + "2", hidden)
        text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
        return around.sub("\n", inline.sub(" ", text)).strip(" \n")

    def question(labels: str) -> str:
        kept = dict.fromkeys(v for v in map(label, labels.split(separator)) if v.lower() not in blanks)
        return "\n".join(kept).replace(hidden, hidden + "2").replace(separator, hidden + "0")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Labels repeat: each different text of a batch is folded once.
            texts = batch.column("_text").dictionary_encode()
            made = [beside.join(map(question, text.split(beside))) for text in texts.dictionary.to_pylist()]
            folded = pc.take(pa.array(made, texts.type.value_type), texts.indices)
            yield batch.set_column(batch.schema.get_field_index("_text"), "_text", folded)

    return fold


def fold_responses(responses: DataFrame, plan: DataFrame, rows: int | None = None) -> DataFrame:
    """Fold cells by the column plan; responses of surveys without a plan pass unchanged.

    Labels of one multiple-choice question are normalised, blanks dropped, repeats removed in
    column order and joined by line feeds; other cells are kept verbatim.
    """
    per_survey = plan.groupBy("survey_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("col_idx", "multiple", "sources"))),
            lambda p: F.struct(p["multiple"].alias("multiple"), p["sources"].alias("sources")),
        ).alias("_plan")
    )
    # Multiple-choice questions side by side; a column is its source, or -1, -2, ... for these.
    place = lambda i: F.size(F.filter(F.slice("_plan", F.lit(1), i + 1), lambda q: q["multiple"]))
    per_survey = per_survey.withColumn(
        "_wide", F.transform(F.filter("_plan", lambda p: p["multiple"]), lambda p: p["sources"])
    ).withColumn(
        "_plan",
        F.transform("_plan", lambda p, i: F.when(p["multiple"], -place(i)).otherwise(F.get(p["sources"], F.lit(0)))),
    )
    df = dim_join(responses, per_survey, ["survey_id"], "response_id", rows=rows, how="left")
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    side_by_side = F.transform("_wide", lambda w: F.array_join(F.transform(w, lambda i: protect(cell(i))), SEPARATOR))
    # Rows pass through Python whole: beside a column function Spark queues them, on disk if need be.
    df = df.withColumn("_text", F.array_join(side_by_side, BESIDE)).drop("_wide")
    df = df.mapInArrow(_label_folder(), df.schema)
    df = staged(df, _labels=F.split("_text", BESIDE))

    def folded(source: Column) -> Column:
        return F.when(source < 0, restore(F.get("_labels", -source - 1))).otherwise(cell(source))

    cells = F.when(F.col("_plan").isNull(), F.col("cells")).otherwise(
        F.transform("_plan", folded)
    )
    return df.withColumn("cells", cells).drop("_plan", "_text", "_labels")


def fold_paired(columns: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold every paired export among the surveys; returns (columns, responses).

    The returned columns are (survey_id, col_idx, header, forced_kind).
    """
    paired = detect_layout(columns).where("paired").select("survey_id")
    # Made of headers only, and read by every pass over the responses.
    plan = pin(column_plan(columns.join(paired, "survey_id", "left_semi")))
    plain = columns.join(paired, "survey_id", "left_anti").select(
        "survey_id", "col_idx", "header", F.lit(None).cast("string").alias("forced_kind")
    )
    folded = plan.select("survey_id", "col_idx", "header", "forced_kind")
    return folded.unionByName(plain), fold_responses(responses, plan)
