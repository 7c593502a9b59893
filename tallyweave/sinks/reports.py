"""Report tables and text lines; writers keep the line order without one big task.

Text reports are (survey_id, section, position, part, line) tables. Sorting by the leading
columns gives the document; `write_lines` does so with a distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.constants import EMPTY_PLACEHOLDER, FREE_PLACEHOLDER, TOTAL_LABEL
from tallyweave.functions.numbers import display_int, fixed, grouped
from tallyweave.model import Survey
from tallyweave.operators import crosstab as ct
from tallyweave.operators.joins import dim_join
from tallyweave.operators.policy import free_text_entries, mask_cells, visible_columns
from tallyweave.operators.units import KEY, analysed
from tallyweave.plans.survey import GENERATOR, Analysis

BOM = "\ufeff"
ORDER = ["survey_id", "section", "position", "part"]

# ---- fixed values: report wording ---------------------------------------------------------
TITLE = "# 生成AI仕事利用アンケート 集計結果"
MULTIPLE_NOTE = "※複数回答（合計が100%を超えることがあります）"
FREE_COUNT = "回答件数: {n}件（本文は個人情報配慮のため出力しません）"
NO_ANSWERS = "（集計対象となる回答がありません）"
OPTION_HEADER = ("| 選択肢 | 人数 | 割合 |", "|---|---:|---:|")
METHOD_NOTES = (
    "---",
    "",
    "**集計仕様**",
    "",
    "- 割合の分母は各質問の有効回答数（集計対象のうち、その質問に回答した人数）です。未回答は分母に含めていません。",
    "- 複数回答の質問は回答者ベース（延べ選択数ではなく、その選択肢を選んだ実人数）で数えているため、割合の合計は100%を超えます。",
    "- 集計対象から除外した回答は、すべての集計に含めていません。",
    "- 自由記述の本文は個人情報配慮のため出力していません（件数のみ）。",
    "",
)
FREE_TITLE = "# 自由記述回答"
NO_FREE_QUESTIONS = "（自由記述として扱っている設問がありません）"
NO_FREE_ANSWERS = "（集計対象の回答に自由記述がありません）"
MODE_LABELS = {
    "count": "実数（人）",
    "row": "実数（行%）… 割合の分母は各行の該当者数",
    "col": "実数（列%）… 割合の分母は各列の該当者数",
    "total": "実数（全体%）… 割合の分母は対象者数の合計",
}
ROW_NOTE = "※行の質問は複数回答のため、1人が複数の行に含まれます（行の合計は対象者数を超えます）"
COL_NOTE = "※列の質問は複数回答のため、1人が複数の列に含まれます（列の合計は対象者数を超えます）"


# ---- text helpers -------------------------------------------------------------------------


def csv_escape(c: Column) -> Column:
    """RFC 4180: quote only when the value needs it."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('["\\r\\n,]'), quoted).otherwise(c)


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_escape), ",")


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\\r\\n|\\r|\\n", " ")


def _number(v: Column, decimals: int | None = None) -> Column:
    """Grouped number; without decimals given, whole numbers plain and others with one."""
    d = F.lit(decimals) if decimals is not None else F.when(v == F.floor(v), 0).otherwise(1)
    return grouped(fixed(v.cast("double"), d))


def _strings(*lines: str | Column) -> list[Column]:
    return [F.lit(x) if isinstance(x, str) else x for x in lines]


def _explode_lines(df: DataFrame, section: Column, position: Column, lines: Column) -> DataFrame:
    return df.select(
        "survey_id",
        section.cast("int").alias("section"),
        position.cast("bigint").alias("position"),
        F.posexplode(lines).alias("part", "line"),
    )


# ---- frequency reports --------------------------------------------------------------------


def summary_rows(analysis: Analysis) -> DataFrame:
    """One row per option or bin; a question without items still gets one row."""
    q = analysed(analysis.survey).select(*KEY, "q_ord", F.col("label").alias("question"), "kind")
    stats = analysis.stats.select(*KEY, "multiple", "valid")
    df = q.join(stats, KEY).join(analysis.items, KEY, "left")
    free = F.col("kind") == "free"
    placeholder = F.when(free, FREE_PLACEHOLDER).otherwise(EMPTY_PLACEHOLDER)
    bare = F.col("label").isNull()
    return df.select(
        "survey_id",
        "q_ord",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        "question",
        F.when(bare, placeholder).otherwise(F.col("label")).alias("option"),
        F.when(bare, F.when(free, F.col("valid")).otherwise(0)).otherwise(F.col("count")).alias("count"),
        F.when(bare, F.when(free & (F.col("valid") > 0), 100.0).otherwise(0.0))
        .otherwise(F.col("percentage"))
        .alias("percentage"),
        F.col("valid").alias("valid_responses"),
        F.col("multiple").alias("multiple_choice"),
    )


def summary_csv(analysis: Analysis) -> DataFrame:
    """Lines of summary.csv."""
    cells = F.array(
        F.col("question"),
        F.col("option"),
        F.col("count").cast("string"),
        F.format_string("%.2f", F.col("percentage")),
        F.col("valid_responses").cast("string"),
        F.col("multiple_choice").cast("string"),
    )
    body = summary_rows(analysis).select(
        "survey_id", F.lit(1).alias("section"), F.col("q_ord").cast("bigint").alias("position"),
        F.col("rank").cast("int").alias("part"), csv_line(cells).alias("line"),
    )
    header = "question,option,count,percentage,valid_responses,multiple_choice"
    head = analysis.counters.select(
        "survey_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.lit(0).alias("part"), F.lit(header).alias("line"),
    )
    return head.unionByName(body)


def summary_markdown(analysis: Analysis, generator: str = GENERATOR, title: str = TITLE) -> DataFrame:
    """Lines of the Markdown summary; free-text bodies never appear."""
    n = lambda name: F.concat(display_int(F.col(name)), F.lit("件"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    meta = F.array(
        *_strings(
            title, "",
            F.concat(F.lit("- データ名: "), F.when(F.col("survey_id") == "", "（不明）").otherwise(F.col("survey_id"))),
            F.concat(F.lit("- 生成日時: "), stamp),
            f"- 出力元: {generator}",
            F.concat(F.lit("- 全回答数: "), n("total")),
            F.concat(F.lit("- 有効回答数(集計対象): "), n("included")),
            F.concat(F.lit("- 除外回答数: "), n("excluded")),
            "",
        )
    )
    at = lambda v: F.lit(v)
    head = _explode_lines(analysis.counters, at(0), at(0), meta)
    notes = _explode_lines(analysis.counters, at(2), at(0), F.array(*_strings(*METHOD_NOTES)))

    q = analysed(analysis.survey).select(*KEY, "q_ord", F.col("label").alias("question"), "unit")
    has_items = analysis.items.groupBy(*KEY).agg(F.lit(True).alias("_items"))
    df = (
        q.join(analysis.stats.drop("q_ord"), KEY)
        .join(analysis.numeric, KEY, "left")
        .join(has_items, KEY, "left")
    )
    base = F.concat(
        F.lit("有効回答数: "), n("valid"), F.lit("（未回答 "), n("blank"), F.lit(" / 集計対象 "),
        F.concat(display_int(F.col("valid") + F.col("blank")), F.lit("件")), F.lit("）"),
    )
    unit = F.coalesce("unit", F.lit(""))
    read = F.concat(F.lit("- 件数: "), n("n"))
    unread = F.concat(read, F.lit("（うち数値として読み取れなかった回答 "), n("unparsed"), F.lit("）"))
    measure = lambda name, column, d=None: F.concat(F.lit(f"- {name}: "), _number(F.col(column), d), unit)
    numeric = F.array(
        F.when(F.col("unparsed") > 0, unread).otherwise(read),
        measure("平均", "mean", 1), measure("中央値", "median", 1), measure("最小", "min"),
        measure("最大", "max"), measure("第1四分位", "p25"), measure("第3四分位", "p75"), F.lit(""),
    )
    none = F.array().cast("array<string>")
    is_free = F.col("kind") == "free"
    prefix, suffix = FREE_COUNT.split("{n}件")
    tail = (
        F.when(is_free, F.array(F.concat(F.lit(prefix), n("valid"), F.lit(suffix)), F.lit("")))
        .when(F.col("_items").isNull(), F.array(*_strings(NO_ANSWERS, "")))
        .otherwise(F.array(*_strings(*OPTION_HEADER)))
    )
    block = F.concat(
        F.array(F.concat(F.lit("## "), F.col("question")), F.lit("")),
        F.when(F.col("multiple"), F.array(*_strings(MULTIPLE_NOTE, ""))).otherwise(none),
        F.array(base, F.lit("")),
        F.when((F.col("kind") == "numeric") & F.col("n").isNotNull(), numeric).otherwise(none),
        tail,
    )
    # Three positions per question: heading block, option rows, closing blank line.
    slot = lambda k: F.col("q_ord").cast("bigint") * 3 + k
    opening = _explode_lines(df, at(1), slot(0), block)
    row = F.concat(
        F.lit("| "), markdown_escape(F.col("label")), F.lit(" | "), display_int(F.col("count")),
        F.lit(" | "), fixed(F.col("percentage"), F.lit(1)), F.lit("% |"),
    )
    options = analysis.items.join(q.select(*KEY, "q_ord"), KEY).select(
        "survey_id", F.lit(1).alias("section"), slot(1).alias("position"),
        F.col("rank").cast("int").alias("part"), row.alias("line"),
    )
    closing = _explode_lines(
        df.where(F.col("_items").isNotNull() & ~is_free), at(1), slot(2), F.array(F.lit(""))
    )
    return head.unionByName(opening).unionByName(options).unionByName(closing).unionByName(notes)


# ---- free text ----------------------------------------------------------------------------


def free_text_markdown(survey: Survey, counters: DataFrame) -> DataFrame:
    """Lines of the free-text report: included responses with at least one answer, verbatim."""
    entries = free_text_entries(survey)
    labels = (
        survey.questions.where("kind = 'free'")
        .groupBy("survey_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("q_ord", "label"))), lambda s: s["label"]).alias("labels"))
    )
    answered = entries.groupBy("survey_id").agg(F.count(F.lit(1)).alias("entries"))
    top = counters.join(labels, "survey_id", "left").join(answered, "survey_id", "left")
    top = top.withColumn("entries", F.coalesce("entries", F.lit(0)))
    none = F.array().cast("array<string>")
    line = lambda label, n: F.concat(F.lit(label), F.col(n).cast("string"), F.lit("件"))
    named = F.array(F.concat(F.lit("対象の設問: "), F.array_join("labels", " / ")))
    ending = (
        F.when(F.col("labels").isNull(), F.array(*_strings(NO_FREE_QUESTIONS, "")))
        .when(F.col("entries") == 0, F.array(*_strings(NO_FREE_ANSWERS, "")))
        .otherwise(none)
    )
    head = F.concat(
        F.array(*_strings(FREE_TITLE, "", line("集計対象回答数: ", "included"), line("自由記述あり: ", "entries"))),
        F.when(F.col("labels").isNotNull(), named).otherwise(none),
        F.array(F.lit("")),
        ending,
    )
    many = F.size("labels") > 1

    def body(b: Column) -> Column:
        titled = F.array(F.concat(F.lit("**"), b["label"], F.lit("**")), F.lit(""))
        return F.concat(F.when(many, titled).otherwise(none), F.array(b["body"], F.lit("")))

    heading = F.array(
        F.concat(F.lit("## 回答 "), (F.col("response_id") + 1).cast("string")), F.lit("")
    )
    # Bodies may be long, so the small label list travels to them.
    rows = dim_join(entries, labels, ["survey_id"], "response_id", rows=survey.traits.rows)
    blocks = F.concat(heading, F.flatten(F.transform("bodies", body)))
    return _explode_lines(top, F.lit(0), F.lit(0), head).unionByName(
        _explode_lines(rows, F.lit(1), F.col("response_id"), blocks)
    )


# ---- cross-tab reports --------------------------------------------------------------------


def _pair_labels(survey: Survey, pairs: ct.Pairs) -> DataFrame:
    pairs = ct.pair_table(survey, pairs)
    q = survey.questions.select("survey_id", "q_key", "label", "kind")
    row = q.toDF("survey_id", "row_key", "row_question", "row_kind")
    col = q.toDF("survey_id", "col_key", "col_question", "col_kind")
    return pairs.join(row, ["survey_id", "row_key"], "left").join(col, ["survey_id", "col_key"], "left")


def _row_position(rank: Column) -> Column:
    return F.coalesce(rank, F.lit(9223372036854775807))


def crosstab_csv(survey: Survey, tidy: DataFrame, pairs: ct.Pairs, mode: str = "count") -> DataFrame:
    """Lines of cross-tab.csv per pair; cells are counts whatever the display mode."""
    labels = _pair_labels(survey, pairs)
    grand = tidy.select(*ct.PAIR, "grand_total").distinct()
    top = labels.join(grand, ct.PAIR, "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    comment = F.concat(
        F.lit("# 行: "), text("row_question"), F.lit(" / 列: "), text("col_question"),
        F.lit(" / 有効回答者数: "), F.coalesce("grand_total", F.lit(0)).cast("string"),
        F.lit(f" / 表示: {mode}"),
    )
    head = top.select(
        *ct.PAIR, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.lit(0).alias("part"), csv_escape(comment).alias("line"),
    )
    matrix = ct.matrix_rows(tidy).join(labels, ct.PAIR)
    is_head = F.col("row_rank") == 0
    first = F.when(is_head, text("row_question")).otherwise(F.col("row_label"))
    last = F.when(is_head, F.lit(TOTAL_LABEL)).otherwise(F.col("total").cast("string"))
    cells = F.concat(F.array(first), F.col("cells"), F.array(last))
    body = matrix.select(
        *ct.PAIR, F.lit(1).alias("section"), _row_position(F.col("row_rank")).alias("position"),
        F.lit(0).alias("part"), csv_line(cells).alias("line"),
    )
    # Pairs without any answers still get a header and a totals line.
    empty = top.where("grand_total is null").select(
        *ct.PAIR, F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.posexplode(
            F.array(
                csv_line(F.array(text("row_question"), F.lit(TOTAL_LABEL))),
                csv_line(F.array(F.lit(TOTAL_LABEL), F.lit("0"))),
            )
        ).alias("part", "line"),
    )
    return head.unionByName(body).unionByName(empty)


def crosstab_markdown(survey: Survey, tidy: DataFrame, pairs: ct.Pairs, mode: str = "count") -> DataFrame:
    """Lines of the Markdown cross-tab with cells in the chosen display mode."""
    labels = _pair_labels(survey, pairs)
    grand = tidy.select(*ct.PAIR, "grand_total").distinct()
    top = labels.join(grand, ct.PAIR, "left").withColumn("grand_total", F.coalesce("grand_total", F.lit(0)))
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    note = lambda kind, words: F.when(F.col(kind) == "multiple", F.array(*_strings(words, ""))).otherwise(none)
    lines = F.concat(
        F.array(
            *_strings(
                F.concat(F.lit("## クロス集計: "), text("row_question"), F.lit(" × "), text("col_question")),
                "",
                F.concat(F.lit("対象者数（行・列の両方に有効回答）: "), display_int(F.col("grand_total")), F.lit("件")),
                f"表示: {MODE_LABELS[mode]}",
                "",
            )
        ),
        note("row_kind", ROW_NOTE),
        note("col_kind", COL_NOTE),
        F.when(F.col("grand_total") == 0, F.array(*_strings(NO_ANSWERS, ""))).otherwise(none),
    )
    at = lambda s, p: (F.lit(s).alias("section"), p.cast("bigint").alias("position"))
    head = top.select(*ct.PAIR, *at(0, F.lit(0)), F.posexplode(lines).alias("part", "line"))

    matrix = ct.matrix_rows(tidy, ct.cell_text(mode)).join(labels, ct.PAIR)
    is_head, is_total = F.col("row_rank") == 0, F.col("row_rank").isNull()
    first = F.when(is_head, markdown_escape(text("row_question"))).when(is_total, F.lit(TOTAL_LABEL))
    first = first.otherwise(markdown_escape(F.col("row_label")))
    last = F.when(is_head, F.lit(TOTAL_LABEL)).otherwise(display_int(F.col("total")))
    cells = (
        F.when(is_head, F.transform("cells", markdown_escape))
        .when(is_total, F.transform("cells", grouped))
        .otherwise(F.col("cells"))
    )
    row = F.concat(
        F.lit("| "), F.array_join(F.concat(F.array(first), cells, F.array(last)), " | "), F.lit(" |")
    )
    rule = F.concat(F.lit("|---"), F.repeat(F.lit("|---:"), F.size("cells") + 1), F.lit("|"))
    block = F.when(is_head, F.array(row, rule)).when(is_total, F.array(row, F.lit(""))).otherwise(F.array(row))
    body = matrix.select(
        *ct.PAIR, *at(1, _row_position(F.col("row_rank"))), F.posexplode(block).alias("part", "line")
    )
    return head.unionByName(body)


# ---- audit export -------------------------------------------------------------------------


def audit_rows(survey: Survey, hidden: DataFrame | None = None) -> DataFrame:
    """All responses, excluded ones flagged: (survey_id, no, cells, included)."""
    responses = survey.responses
    if hidden is not None:
        responses = mask_cells(responses, hidden, survey.traits.rows)
    return responses.select(
        "survey_id",
        (F.col("response_id") + 1).alias("no"),
        "cells",
        F.coalesce("included", F.lit(False)).alias("included"),
    )


def audit_csv(survey: Survey, hidden: DataFrame | None = None) -> DataFrame:
    """Lines of responses.csv: No, visible source columns, included."""
    columns = survey.columns if hidden is None else visible_columns(survey.columns, hidden)
    header = columns.groupBy("survey_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda s: s["header"]).alias("h")
    )
    top = header.select(
        "survey_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"), F.lit(0).alias("part"),
        csv_line(F.concat(F.array(F.lit("No")), F.col("h"), F.array(F.lit("included")))).alias("line"),
    )
    cells = F.concat(
        F.array(F.col("no").cast("string")),
        F.transform("cells", lambda c: F.coalesce(c, F.lit(""))),
        F.array(F.col("included").cast("string")),
    )
    body = audit_rows(survey, hidden).select(
        "survey_id", F.lit(1).alias("section"), F.col("no").cast("bigint").alias("position"),
        F.lit(0).alias("part"), csv_line(cells).alias("line"),
    )
    return top.unionByName(body)


# ---- writers ------------------------------------------------------------------------------


def write_lines(
    lines: DataFrame, path: str, bom: bool = False, line_sep: str = "\n", mode: str = "errorifexists"
) -> None:
    """Write one document's lines as ordered text parts; part files concatenate to the text.

    The sort is range-partitioned, so a document of any size is written by many tasks. With
    `bom`, U+FEFF precedes the first line for spreadsheet programs.
    """
    keys = [c for c in (*ct.PAIR, *ORDER[1:]) if c in lines.columns]
    first = (F.col("section") == 0) & (F.col("position") == 0) & (F.col("part") == 0)
    text = F.when(first & F.lit(bom), F.concat(F.lit(BOM), F.col("line"))).otherwise(F.col("line"))
    lines.orderBy(*keys).select(text.alias("value")).write.mode(mode).option("lineSep", line_sep).text(path)


def write_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write each survey's nested result as pretty-printed JSON, one document per survey."""
    text = F.to_json("document", {"pretty": "true", "ignoreNullFields": "true"})
    documents.select("survey_id", text.alias("value")).write.mode(mode).partitionBy("survey_id").text(path)
