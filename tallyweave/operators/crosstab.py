"""Cross-tabulation of question pairs with distinct-respondent margins.

Respondents are first counted per distinct pair of raw cells. Every distinct pair is then
expanded to (row option or total) x (column option or total): a respondent adds one to each
combination, so cells, margins and grand total are plain sums of one aggregation and no
count(DISTINCT) is needed. A cell's text is interpreted once, however many others it meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.constants import TOTAL_LABEL
from tallyweave.functions.numbers import fixed
from tallyweave.functions.text import key_of, let, natural_key
from tallyweave.model import Survey
from tallyweave.operators.frequency import option_order
from tallyweave.operators.joins import BROADCAST_ROWS, dim_join, grown_join, is_small
from tallyweave.operators.numeric import bin_lookup, looked_up_label, value_counts
from tallyweave.operators.ranking import ranked
from tallyweave.operators.units import (
    cell_sources,
    interpret,
    interpreted_units,
    source_columns,
    with_dictionaries,
)
from tallyweave.session import pin, staged

PAIR = ["survey_id", "row_key", "col_key"]
ELIGIBLE = ("single", "multiple", "numeric")
MODES = ("count", "row", "col", "total")
MAX_REPORT_COLUMNS = 10_000
SPEC_PAIRS = 1_000
_SPEC = ("kind", "delimiters", "unit", "derived", "alias_index")
_RAW = ("r_raw", "r_raw2", "c_raw", "c_raw2")


def eligible(questions: DataFrame) -> DataFrame:
    """Questions usable as an axis, whether or not they are selected for output."""
    return questions.where(F.col("kind").isin(*ELIGIBLE))


# Pairs of question keys: a table keyed by survey, or a list for the one hand-written survey.
Pairs = DataFrame | list[tuple[str, str]]


def _single_survey(survey: Survey) -> bool:
    return len({r[0] for r in survey.rows or ()}) == 1


def pair_table(survey: Survey, pairs: Pairs) -> DataFrame:
    if isinstance(pairs, DataFrame):
        return pairs
    if not _single_survey(survey):
        raise ValueError("a list of pairs needs a bundle of one hand-written survey")
    schema = "survey_id string, row_key string, col_key string"
    return survey.spark.createDataFrame([(survey.rows[0][0], *p) for p in pairs], schema)


def all_pairs(survey: Survey) -> Pairs:
    """Every unordered pair of eligible questions of a survey, in definition order."""
    if _single_survey(survey):
        keys = [r[2] for r in sorted(survey.rows, key=lambda r: r[1]) if r[6] in ELIGIBLE]
        return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    q = eligible(survey.questions).select("survey_id", "q_key", "q_ord")
    left = q.toDF("survey_id", "row_key", "_i")
    right = q.toDF("survey_id", "col_key", "_j")
    return left.join(right, "survey_id").where("_i < _j").select(*PAIR)


def _listed_pairs(survey: Survey, responses: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Raw cells of each pair straight from the named columns, without a join."""
    source = {r[2]: source_columns(r) for r in survey.rows if r[6] in ELIGIBLE}
    known = [(a, b) for a, b in pairs if a in source and b in source]
    used = sorted({i for p in known for k in p for i in source[k] if i is not None})
    own = responses.where(F.col("survey_id") == survey.rows[0][0]).select(
        "survey_id",
        "response_id",
        *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"_{i}") for i in used],
    )
    none = F.lit(None).cast("string")
    cell = lambda i: none if i is None else F.col(f"_{i}")
    specs = [
        F.struct(
            F.lit(row).alias("row_key"),
            F.lit(col).alias("col_key"),
            *[
                cell(i).alias(name)
                for name, i in zip(_RAW, (*source[row], *source[col]))
            ],
        )
        for row, col in known
    ]
    empty = "array<struct<row_key:string,col_key:string," + ",".join(f"{n}:string" for n in _RAW) + ">>"
    made = F.array(*specs) if specs else F.array().cast(empty)
    return own.select("survey_id", "response_id", F.inline(made))


def pair_cells(survey: Survey, pairs: Pairs) -> DataFrame:
    """(pair, response_id, raw cells of both sides) of included responses."""
    responses = survey.responses.where("included").select("survey_id", "response_id", "cells")
    if not isinstance(pairs, DataFrame):
        return _listed_pairs(survey, responses, pairs)
    source = cell_sources(eligible(survey.questions)).drop("kind")
    rows = source.toDF("survey_id", "row_key", "ra", "rb")
    cols = source.toDF("survey_id", "col_key", "ca", "cb")
    asked = pin(pairs.join(rows, ["survey_id", "row_key"]).join(cols, ["survey_id", "col_key"]))
    # A survey's pairs travel as arrays of bounded length; their number decides on a broadcast.
    count = asked.count()
    part = F.pmod(F.xxhash64("row_key", "col_key"), F.lit(max(1, count // SPEC_PAIRS)))
    specs = (
        asked.groupBy("survey_id", part.alias("_part"))
        .agg(F.collect_list(F.struct("row_key", "col_key", "ra", "rb", "ca", "cb")).alias("specs"))
        .drop("_part")
    )
    joined = dim_join(responses, specs, ["survey_id"], "response_id", rows=count)
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    second = lambda i: F.when(i.isNotNull(), cell(i))

    def picked(s: Column) -> Column:
        return F.struct(
            s["row_key"].alias("row_key"),
            s["col_key"].alias("col_key"),
            cell(s["ra"]).alias("r_raw"),
            second(s["rb"]).alias("r_raw2"),
            cell(s["ca"]).alias("c_raw"),
            second(s["cb"]).alias("c_raw2"),
        )

    return joined.select("survey_id", "response_id", F.inline(F.transform("specs", picked)))


def pair_units(survey: Survey, pairs: Pairs) -> DataFrame:
    """Distinct pairs of raw cells with respondents and first respondent, one raw-data pass."""
    return (
        pair_cells(survey, pairs)
        .groupBy(*PAIR, *_RAW)
        .agg(F.count(F.lit(1)).alias("n"), F.min("response_id").alias("first_id"))
    )


# Stands for "no second cell" in join keys.
_NO_SECOND = "\uFDD1"


def _options(units: DataFrame, survey: Survey, spec: DataFrame, layout: DataFrame | None) -> DataFrame:
    """(survey_id, q_key, raw, raw2, options): every distinct cell of either side, interpreted once.

    Numeric answers become bin labels; cells without an option are left out.
    """
    on = ["survey_id", "q_key"]
    sides = [
        units.select("survey_id", F.col(key).alias("q_key"), F.col(f"{side}_raw").alias("raw"), F.col(f"{side}_raw2").alias("raw2"))
        for side, key in (("r", "row_key"), ("c", "col_key"))
    ]
    cells = sides[0].unionByName(sides[1]).distinct()
    df = interpret(dim_join(cells, spec, on, "raw", rows=survey.traits.rows), survey.traits)
    options = F.col("options")
    if layout is not None:
        df = dim_join(df, layout, on, "raw", rows=survey.traits.rows, how="left")
        label = looked_up_label(F.col("num"))
        binned = let(label, lambda t: F.array(F.struct(key_of(t).alias("key"), t.alias("label"))))
        options = F.when(F.col("kind") != "numeric", options).when(label.isNotNull(), binned)
    # Computed and tested in one step: a later filter would compute the options again.
    df = staged(
        df.select(*on, "raw", F.coalesce("raw2", F.lit(_NO_SECOND)).alias("raw2"), options.alias("_options")),
        keep=lambda s: F.size(s["options"]) > 0,
        options=F.col("_options"),
    )
    return df.drop("_options")


def _axis(units: DataFrame, options: DataFrame, pairs: DataFrame, side: str, key: str) -> DataFrame:
    """Replace one side's raw cells by its options; `pairs` are the units with both cells."""
    keys = pairs.select("survey_id", key).distinct()
    named = options.toDF("survey_id", key, f"{side}_raw", f"{side}_raw2", f"{side}_options")
    named = dim_join(named, keys, ["survey_id", key], f"{side}_raw", how="left_semi")
    filled = units.withColumn(f"{side}_raw2", F.coalesce(f"{side}_raw2", F.lit(_NO_SECOND)))
    # Cells of one axis may be as many as the pairs, so they are not repeated per salt; the many
    # pairs of a frequent cell are split by Spark's skew join.
    on = ["survey_id", key, f"{side}_raw", f"{side}_raw2"]
    joined = filled.join(F.broadcast(named), on) if is_small(named) else grown_join(filled, named, on)
    return joined.drop(f"{side}_raw", f"{side}_raw2")


def crosstab_cube(survey: Survey, pairs: Pairs, value_units: DataFrame | None = None) -> DataFrame:
    """(pair, row_opt, row_label, col_opt, col_label, n); a NULL option is the total."""
    questions = eligible(survey.questions)
    spec = with_dictionaries(questions, survey.traits).select("survey_id", "q_key", *_SPEC)
    layout = None
    if "numeric" in survey.traits.kinds:
        # Bins come from all included responses, not only from those answering both questions.
        if value_units is None:
            value_units = pin(interpreted_units(survey, kinds=("numeric",)))
        values = value_counts(value_units.where("kind = 'numeric'"))
        layout = pin(bin_lookup(values, questions.select("survey_id", "q_key", "unit")))
    units = pin(pair_units(survey, pairs))
    options = pin(_options(units, survey, spec, layout))
    pairs_of_cells = units
    for side, key in (("r", "row_key"), ("c", "col_key")):
        units = _axis(units, options, pairs_of_cells, side, key)

    total = F.array(F.lit(None).cast("struct<key:string,label:string>"))
    combos = F.flatten(
        F.transform(
            F.concat(total, "r_options"),
            lambda r: F.transform(
                F.concat(total, F.col("c_options")),
                lambda c: F.struct(
                    r["key"].alias("row_opt"),
                    r["label"].alias("row_label"),
                    c["key"].alias("col_opt"),
                    c["label"].alias("col_label"),
                ),
            ),
        )
    )
    spelled = (
        units.select(*PAIR, "n", "first_id", F.inline(combos))
        .groupBy(*PAIR, "row_opt", "row_label", "col_opt", "col_label")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    )
    return spelled.groupBy(*PAIR, "row_opt", "col_opt").agg(
        F.sum("n").alias("n"),
        F.min_by("row_label", "first_id").alias("row_label"),
        F.min_by("col_label", "first_id").alias("col_label"),
    )


def axis_labels(survey: Survey, cube: DataFrame) -> DataFrame:
    """(pair, axis, opt, label, count, rank): occurring labels ordered by each question's rule."""
    row = cube.where("row_opt is not null and col_opt is null").select(
        *PAIR, F.lit("row").alias("axis"), F.col("row_key").alias("q_key"),
        F.col("row_opt").alias("opt"), F.col("row_label").alias("label"), F.col("n").alias("count"),
    )
    col = cube.where("row_opt is null and col_opt is not null").select(
        *PAIR, F.lit("col").alias("axis"), F.col("col_key").alias("q_key"),
        F.col("col_opt").alias("opt"), F.col("col_label").alias("label"), F.col("n").alias("count"),
    )
    rules = with_dictionaries(survey.questions, survey.traits).select(
        "survey_id", "q_key", "opt_order", "preset_keys"
    )
    position = F.array_position("preset_keys", F.col("opt"))
    placed = (
        dim_join(row.unionByName(col), rules, ["survey_id", "q_key"], "opt", rows=survey.traits.rows)
        .withColumn("_place", F.when(position > 0, position))
        .withColumn("_natural", natural_key(F.col("label")))
        .drop("preset_keys")
    )
    return ranked(placed, [*PAIR, "axis"], option_order(), at_most=cube.count()).select(
        *PAIR, "axis", "opt", "label", "count", "rank"
    )


def crosstab(
    survey: Survey, pairs: Pairs, value_units: DataFrame | None = None, cube: DataFrame | None = None
) -> DataFrame:
    """Tidy cross-tab: one row per occurring cell with its margins and both ranks."""
    cube = pin(crosstab_cube(survey, pairs, value_units) if cube is None else cube)
    labels = pin(axis_labels(survey, cube))
    side = lambda axis, name: labels.where(F.col("axis") == axis).select(
        *PAIR,
        F.col("opt").alias(f"{name}_opt"),
        F.col("label").alias(f"{name}_label"),
        F.col("rank").alias(f"{name}_rank"),
        F.col("count").alias(f"{name}_total"),
    )
    grand = cube.where("row_opt is null and col_opt is null").select(
        *PAIR, F.col("n").alias("grand_total")
    )
    cells = cube.where("row_opt is not null and col_opt is not null").select(
        *PAIR, "row_opt", "col_opt", F.col("n").alias("count")
    )
    # Labels of one pair may be many and its cells more: the joins are spread by the other side.
    many = labels.limit(BROADCAST_ROWS + 1).count()
    with_rows = dim_join(cells, side("row", "row"), [*PAIR, "row_opt"], "col_opt", rows=many)
    with_both = dim_join(with_rows, side("col", "col"), [*PAIR, "col_opt"], "row_opt", rows=many)
    return (
        dim_join(with_both, grand, PAIR, "row_opt", rows=many)
        .select(
            *PAIR, "row_rank", "row_label", "col_rank", "col_label",
            "count", "row_total", "col_total", "grand_total",
        )
    )


def mirrored(ct: DataFrame) -> DataFrame:
    """Both directions of each pair from one computed direction."""
    swap = {"row": "col", "col": "row"}
    turned = ct.select(
        *[F.col(swap[c[:3]] + c[3:] if c[:3] in swap else c).alias(c) for c in ct.columns]
    )
    return ct.unionByName(turned)


def dense(ct: DataFrame) -> DataFrame:
    """Add the zero cells between occurring row and column labels.

    Each row label is repeated once per column position, so the work equals the size of the
    matrix and is spread by row.
    """
    rows = ct.select(*PAIR, "row_rank", "row_label", "row_total", "grand_total").distinct()
    cols = ct.select(*PAIR, "col_rank", "col_label", "col_total").distinct()
    width = cols.groupBy(*PAIR).agg(F.max("col_rank").alias("_width"))
    spine = rows.join(width, PAIR).withColumn(
        "col_rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_width")))
    )
    counts = ct.select(*PAIR, "row_rank", "col_rank", "count")
    return (
        spine.join(counts, [*PAIR, "row_rank", "col_rank"], "left")
        .join(cols, [*PAIR, "col_rank"])
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .select(ct.columns)
    )


def with_shares(ct: DataFrame) -> DataFrame:
    """Row, column and total shares in percent, unrounded."""
    share = lambda name: F.when(F.col(name) > 0, F.col("count") / F.col(name) * 100)
    return ct.withColumns(
        {"row_pct": share("row_total"), "col_pct": share("col_total"), "total_pct": share("grand_total")}
    )


def cell_text(mode: str) -> Column:
    """Displayed cell: '12', or '12 (30.0%)' with the mode's denominator, '12 (-)' without one."""
    count = F.col("count").cast("string")
    if mode == "count":
        return count
    base = F.col({"row": "row_total", "col": "col_total", "total": "grand_total"}[mode])
    share = fixed(F.col("count") / F.nullif(base, F.lit(0)) * 100, F.lit(1))
    return F.concat(count, F.lit(" ("), F.coalesce(F.concat(share, F.lit("%")), F.lit("-")), F.lit(")"))


def matrix_rows(ct: DataFrame, cell: Column | None = None) -> DataFrame:
    """One row per row label with its cells in column order, then one totals row (rank NULL).

    A row's cells are one report line, so its width is the number of column labels; beyond
    MAX_REPORT_COLUMNS the tidy table must be used and the job fails with a message.
    """
    cell = F.col("count").cast("string") if cell is None else cell
    too_wide = F.col("col_rank") > MAX_REPORT_COLUMNS
    message = f"a cross-tab report has more than {MAX_REPORT_COLUMNS} columns; use the tidy table"
    cell = F.when(too_wide, F.raise_error(message)).otherwise(cell)
    line = lambda c: F.transform(
        F.array_sort(F.collect_list(F.struct("col_rank", c.alias("v")))), lambda s: s["v"]
    )
    body = (
        dense(ct)
        .withColumn("_cell", cell)
        .groupBy(*PAIR, "row_rank", "row_label", "row_total")
        .agg(line(F.col("_cell")).alias("cells"))
        .withColumnRenamed("row_total", "total")
    )
    cols = ct.select(*PAIR, "col_rank", "col_label", "col_total", "grand_total").distinct()
    by_pair = cols.groupBy(*PAIR, F.col("grand_total").alias("total"))
    totals = by_pair.agg(line(F.col("col_total").cast("string")).alias("cells")).select(
        *PAIR, F.lit(None).cast("bigint").alias("row_rank"), F.lit(TOTAL_LABEL).alias("row_label"),
        "total", "cells",
    )
    header = by_pair.agg(line(F.col("col_label")).alias("cells")).select(
        *PAIR, F.lit(0).cast("bigint").alias("row_rank"), F.lit(None).cast("string").alias("row_label"),
        "total", "cells",
    )
    return header.unionByName(body.select(header.columns)).unionByName(totals)


def default_axes(questions: DataFrame, row: str = "", col: str = "") -> DataFrame:
    """Default axis pair per survey: the wished keys if eligible, else gender x AI tools,
    else the first eligible questions; the two axes differ whenever two are eligible."""
    keys = (
        eligible(questions)
        .groupBy("survey_id")
        .agg(F.array_sort(F.collect_list(F.struct("q_ord", "q_key"))).alias("_q"))
        .withColumn("keys", F.transform("_q", lambda s: s["q_key"]))
    )
    has = lambda k: F.array_contains("keys", F.lit(k))
    other = lambda c: F.get(F.filter("keys", lambda k: k != c), F.lit(0))
    first_row = (
        F.when(has(row), F.lit(row))
        .when(has("gender"), F.lit("gender"))
        .otherwise(F.get("keys", F.lit(0)))
    )
    keys = keys.withColumn("row_key", first_row)
    first_col = (
        F.when(has(col), F.lit(col))
        .when(has("ai-tools"), F.lit("ai-tools"))
        .otherwise(F.coalesce(other(F.col("row_key")), F.col("row_key")))
    )
    keys = keys.withColumn("col_key", first_col)
    clash = (F.col("col_key") == F.col("row_key")) & (F.size("keys") > 1)
    return keys.select(
        "survey_id",
        "row_key",
        F.when(clash, other(F.col("row_key"))).otherwise(F.col("col_key")).alias("col_key"),
    )
