"""Survey questions asked of the driver tables, one function per operator family.

Every function reads whole tables and returns a DataFrame. Survey-shaped columns are derived
from table columns; nothing is sampled, cut or filtered to make a query cheap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import answers, numbers, text, worktime
from tallyweave.constants import DAYS_PRESET, MINUTES_PRESET, SAFE_DELIMITERS
from tallyweave.model import Survey, define_survey, question, question_table, table_responses, traits_of
from tallyweave.operators import bitmaps as bm, crosstab as ct, frequency as fr, numeric as nu, policy as po
from tallyweave.operators import questions as qs, upkeep as up
from tallyweave.operators.inference import infer_kinds
from tallyweave.operators.units import interpreted_units
from tallyweave.plans.survey import analysis_documents, analyze
from tallyweave.profiles import Profile
from tallyweave.session import ensure_checkpoint_dir, pin, spread
from tallyweave.sinks import reports as rp
from tallyweave.sources.delimited import assemble, content_lines, parse_lines, profile_files
from tallyweave.sources.layout import detect_layout, fold_paired, named_columns

c, lit = F.col, F.lit


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def heavy(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table ahead of CPU-heavy work on every row."""
    return spread(table(spark, sf, name))


def dealt(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose every row becomes a survey of its own, dealt out evenly."""
    return spread(table(spark, sf, name).select(*columns), evenly=True)


def money(column: str) -> Column:
    return c(column).cast("decimal(18,2)").cast("string")


def _items(freq: DataFrame) -> DataFrame:
    return freq.select("rank", "label", "count", "percentage")


def _freq(spark, responses: DataFrame, *questions: tuple) -> DataFrame:
    return fr.frequency(define_survey(spark, responses, list(questions)))


# ---- frequency ----------------------------------------------------------------------------


def _orders(spark, sf, *cells: Column, included: Column | None = None, sid="orders") -> DataFrame:
    return table_responses(table(spark, sf, "orders"), c("o_orderkey"), list(cells), sid, included)


def q_single_freq(spark, sf):
    """Priorities of orders that are not pending."""
    r = _orders(spark, sf, c("o_orderpriority"), included=c("o_orderstatus") != "P")
    return _items(_freq(spark, r, question("orders", 0, "priority", "single")))


def _with_blanks() -> Column:
    p = c("o_orderpriority")
    return F.when(p == "5-LOW", "-").when(p == "1-URGENT", "N/A").otherwise(p)


def q_freq_with_blanks(spark, sf):
    """Blank answers leave the denominator."""
    s = define_survey(
        spark, _orders(spark, sf, _with_blanks()), [question("orders", 0, "priority", "single")]
    )
    units = pin(interpreted_units(s))
    stats = fr.question_stats(units).select("survey_id", "q_key", "valid", "blank")
    return fr.frequency(s, units).join(stats, ["survey_id", "q_key"]).select(
        "rank", "label", "count", "percentage", "valid", "blank"
    )


def q_question_stats(spark, sf):
    """valid / blank / selections of several questions of two surveys, ignored ones included."""
    orders = _orders(
        spark, sf, _with_blanks(), c("o_orderstatus"),
        F.concat_ws("、", c("o_orderstatus"), c("o_orderpriority"), F.lower("o_orderstatus")),
        money("o_totalprice"), included=c("o_orderstatus") != "F",
    )
    segment = F.when(c("c_acctbal") < 0, "").otherwise(c("c_mktsegment"))
    customer = table_responses(
        table(spark, sf, "customer"), c("c_custkey"), [segment, c("c_name")], "customer"
    )
    s = define_survey(
        spark,
        orders.unionByName(customer),
        [
            question("orders", 0, "priority", "single"),
            question("orders", 1, "status", "single"),
            question("orders", 2, "both", "multiple"),
            question("orders", 3, "price", "numeric"),
            question("customer", 0, "segment", "single"),
            question("customer", 1, "name", "ignore"),
        ],
    )
    return fr.all_question_stats(s, pin(interpreted_units(s))).drop("q_ord")


def _shop_survey(spark, sf) -> Survey:
    """Two surveys with choice questions only."""
    part = table_responses(
        table(spark, sf, "part"), c("p_partkey"), [c("p_brand"), c("p_type"), c("p_name")], "part"
    )
    orders = _orders(spark, sf, c("o_orderpriority"), c("o_orderstatus"))
    return define_survey(
        spark,
        orders.unionByName(part),
        [
            question("orders", 0, "priority", "single", order="preset", presets=["3-medium", "5-low"]),
            question("orders", 1, "status", "single", chart="pie"),
            question("part", 0, "brand", "single", order="natural"),
            question("part", 1, "type", "single", chart="none"),
            question("part", 2, "name", "single"),
        ],
    )


def q_all_questions_freq(spark, sf):
    """All questions of two surveys in one job."""
    return fr.frequency(_shop_survey(spark, sf)).drop("opt_key")


def _flag_cells(spark, sf) -> DataFrame:
    """Orders with their distinct line flags written twice, in two spellings."""
    flags = (
        heavy(spark, sf, "lineitem")
        .select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("flag"))
        .distinct()
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list("flag")).alias("flags"))
    )
    once = F.array_join("flags", "、")
    return flags.withColumn("cell", F.concat(once, lit("\n"), F.lower(once), lit("。")))


def q_multi_freq(spark, sf):
    """Respondents per flag; repeated and differently spelled flags count once."""
    r = table_responses(_flag_cells(spark, sf), c("l_orderkey"), [c("cell")], "flags")
    return _items(_freq(spark, r, question("flags", 0, "flag", "multiple")))


def q_split_brackets(spark, sf):
    """Delimiters inside brackets and quotes do not split."""
    cell = F.concat(
        lit("その他（"), c("p_brand"), lit(","), c("p_type"), lit("），"), c("p_type"),
        lit('；"'), c("p_name"), lit('、x"、、-'),
    )
    r = table_responses(table(spark, sf, "part"), c("p_partkey"), [cell], "part")
    freq = _freq(spark, r, question("part", 0, "q", "multiple"))
    return freq.select("label", "count", "percentage")


_LATIN, _WIDE_LATIN = "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"


def _spelled_event() -> Column:
    e = c("event_type")
    return (
        F.when(c("value") < 5, F.concat(F.upper(e), lit("。")))
        .when(c("value") < 10, F.concat(lit("　"), e, lit(" ")))
        .otherwise(F.translate(e, _LATIN, _WIDE_LATIN))
    )


def q_alias_canon(spark, sf):
    """Spellings meet their alias; without one the earliest spelling is shown."""
    aliases = {"Click": "クリック", "ｐｕｒｃｈａｓｅ": "購入", "click": "unused"}
    r = table_responses(table(spark, sf, "events"), c("event_id"), [_spelled_event()], "events")
    return _items(_freq(spark, r, question("events", 0, "type", "single", aliases=aliases)))


def q_preset_order(spark, sf):
    presets = ["household", "NOT THERE", "BUILDING", "machinery。"]
    r = table_responses(table(spark, sf, "customer"), c("c_custkey"), [c("c_mktsegment")], "s")
    return _items(_freq(spark, r, question("s", 0, "q", "single", order="preset", presets=presets)))


def q_count_order(spark, sf):
    r = table_responses(table(spark, sf, "events"), c("event_id"), [c("event_type")], "s")
    return _items(_freq(spark, r, question("s", 0, "q", "single", order="count")))


def q_natural_order(spark, sf):
    r = table_responses(table(spark, sf, "part"), c("p_partkey"), [c("p_brand")], "s")
    return _items(_freq(spark, r, question("s", 0, "q", "single", order="natural")))


def q_footer_totals(spark, sf):
    return fr.frequency_totals(fr.frequency(_shop_survey(spark, sf)))


def q_record_vs_respondent(spark, sf):
    """Event records next to distinct users per event type."""
    return fr.records_and_respondents(table(spark, sf, "events"), ["event_type"], "user_id")


# ---- scalar functions ---------------------------------------------------------------------


def _odd_name() -> Column:
    wide = F.translate(c("p_name"), _LATIN, _WIDE_LATIN)
    return F.concat(lit("【"), wide, lit("】　"), c("p_type"), lit(" \r\n "), c("p_brand"), lit("。．"))


def q_text_normalise(spark, sf):
    """Normalised text, grouping key and header key of a messy label."""
    odd = _odd_name()
    return table(spark, sf, "part").select(
        "p_partkey",
        text.norm_text(odd).alias("norm"),
        text.norm_key(odd).alias("grouping_key"),
        text.norm_header(odd).alias("header_key"),
    )


def q_blank_predicate(spark, sf):
    """Which cells count as no answer."""
    p = c("p_size")
    cell = (
        F.when(p <= 5, "－").when(p <= 10, " n/A　").when(p <= 15, "なし").when(p <= 20, "ー")
        .when(p <= 25, "ＮＵＬＬ").when(p <= 30, "\n").when(p <= 35, "0").otherwise(c("p_name"))
    )
    cells = table(spark, sf, "part").select(cell.alias("cell"))
    return cells.groupBy(text.is_blank(c("cell")).alias("blank"), "cell").agg(F.count(lit(1)).alias("n"))


def q_document_blanks(spark, sf):
    """Blank test and normalised length of whole documents."""
    t = text.norm_text(c("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.is_blank(c("text")).alias("blank"), F.length(t).cast("bigint").alias("norm_length"),
        F.md5(t).alias("norm_md5"),
    )


def q_numeric_extract(spark, sf):
    """Numbers read from several ways of writing them."""
    size = c("p_size").cast("string")
    upper = (c("p_size") + 5).cast("string")
    grouped = F.format_number(c("p_partkey") * 1000 + c("p_size"), 0)
    n = numbers.parse_number
    return table(spark, sf, "part").select(
        "p_partkey",
        n(F.concat(size, lit("万円"))).alias("man"),
        n(F.concat(size, lit("〜"), upper, lit("千円"))).alias("lent_range"),
        n(F.concat(size, lit("から"), upper)).alias("word_range"),
        n(F.concat(size, lit("時間３０分")), lit("時間")).alias("hours"),
        n(F.concat(size, lit("分")), lit("時間")).alias("minutes"),
        n(F.concat(lit("約"), grouped, lit(" 円"))).alias("grouped"),
        n(F.concat(size, lit("万"), size, lit("千"), size)).alias("mixed"),
        n(F.concat(lit("-"), size)).alias("negative"),
        n(c("p_name")).alias("none"),
    )


def q_year_month(spark, sf):
    """Year-month derived from a two-digit year cell and a month cell; day 29+ has no month."""
    year = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    month = F.when(F.dayofmonth("o_orderdate") > 28, "13月").otherwise(
        F.concat(F.month("o_orderdate").cast("string"), lit("月"))
    )
    derived = ("year-month", 0, 1, None)
    r = _orders(spark, sf, year, month)
    return _items(
        _freq(spark, r, question("orders", 0, "ym", "single", order="natural", derived=derived))
    )


def _work_cell() -> Column:
    n, qty = c("l_linenumber").cast("string"), c("l_quantity").cast("int").cast("string")
    days = (
        F.when(c("l_returnflag") == "R", lit("半日以下"))
        .when(c("l_linenumber") == 2, lit("二日"))
        .otherwise(F.concat(lit("約"), n, lit("日ほど")))
    )
    hours = (
        F.when(c("l_linenumber") == 1, qty)
        .when(c("l_linenumber") <= 3, F.concat(qty, lit("分")))
        .when(c("l_linenumber") == 4, F.concat(qty, lit("時間半程")))
        .otherwise(F.concat(lit("約"), qty, lit("時間"), n, lit("分")))
    )
    both = F.concat(lit("- 作業日数："), days, lit("\n- 合計作業時間："), hours)
    return F.when(c("l_linestatus") == "F", both).when(c("l_linenumber") == 7, lit("")).otherwise(hours)


def _work(spark, sf, key: str, presets) -> DataFrame:
    r = table_responses(
        heavy(spark, sf, "lineitem"), c("l_orderkey") * 8 + c("l_linenumber"), [_work_cell()], "work"
    )
    q = question("work", 0, key, "single", order="preset", presets=presets, derived=(key, None, None, 0))
    return _items(_freq(spark, r, q))


def q_workdays(spark, sf):
    return _work(spark, sf, "work-days", DAYS_PRESET)


def q_workminutes(spark, sf):
    return _work(spark, sf, "work-minutes", MINUTES_PRESET)


# ---- numeric ------------------------------------------------------------------------------


def _price_survey(spark, sf) -> Survey:
    cell = F.when(c("o_orderpriority") == "5-LOW", "不明").otherwise(
        F.concat(money("o_totalprice"), lit("円"))
    )
    r = _orders(spark, sf, cell, sid=c("o_orderstatus"))
    return define_survey(
        spark, r, [question(sid, 0, "price", "numeric", unit="円") for sid in ("F", "O", "P")]
    )


def q_numeric_summary(spark, sf):
    """Summary of prices per status, unparsable answers counted."""
    return nu.numeric_summary(pin(interpreted_units(_price_survey(spark, sf)))).drop("q_key")


def _histograms(s: Survey) -> DataFrame:
    units = pin(interpreted_units(s))
    valid = fr.question_stats(units).select("survey_id", "q_key", "valid")
    return nu.histogram(pin(nu.value_counts(units)), s.questions.select("survey_id", "q_key", "unit"), valid)


def q_hist_discrete(spark, sf):
    """Ten or fewer distinct values: each value is a bin."""
    number = F.concat(c("l_linenumber").cast("string"), lit("回"))
    half = F.when(c("l_returnflag") == "R", lit("なんとも")).otherwise(
        F.floor(c("l_tax") * 100).cast("string")
    )
    r = table_responses(
        table(spark, sf, "lineitem"), c("l_orderkey") * 8 + c("l_linenumber"), [number, half], "s"
    )
    s = define_survey(
        spark, r, [question("s", 0, "line", "numeric", unit="回"), question("s", 1, "tax", "numeric")]
    )
    return _histograms(s).drop("survey_id")


def q_hist_nice(spark, sf):
    """Readable bin widths for many distinct values; empty bins stay."""
    orders = _price_survey(spark, sf)
    part = table_responses(
        table(spark, sf, "part"), c("p_partkey"),
        [F.concat(c("p_size").cast("string"), lit("回")), money("p_retailprice")], "part",
    )
    more = [question("part", 0, "size", "numeric", unit="回"), question("part", 1, "retail", "numeric")]
    table_, traits = question_table(
        spark, [question(sid, 0, "price", "numeric", unit="円") for sid in ("F", "O", "P")] + more
    )
    s = Survey(orders.responses.unionByName(part), table_, traits=traits)
    return _histograms(s)


# ---- free text ----------------------------------------------------------------------------


def _documents_by_source(spark, sf) -> Survey:
    """One survey per document source with one free question."""
    docs = table(spark, sf, "documents")
    r = table_responses(docs, c("doc_id"), [c("text")], c("source"))
    one, traits = question_table(spark, [question("", 0, "text", "free", label="本文")])
    sources = docs.select(c("source").alias("survey_id")).distinct().withColumn("_k", lit(1))
    # The same hand-written question for every source.
    each = sources.join(F.broadcast(one.drop("survey_id").withColumn("_k", lit(1))), "_k")
    questions = pin(each.select(*one.columns))
    return Survey(r, questions, traits=traits_of(questions))


def q_free_text_sample(spark, sf):
    """First twenty answers per source, normalised and cut for display."""
    return po.free_text_samples(_documents_by_source(spark, sf)).drop("q_key")


def q_free_text_report(spark, sf):
    """Lines of the free-text report of every source, bodies verbatim."""
    s = _documents_by_source(spark, sf)
    return rp.free_text_markdown(s, fr.survey_counters(s.responses))


# ---- profiling ----------------------------------------------------------------------------

_HEADERS = {
    "events": ("Event type", "Value", "Props", "User"),
    "orders": ("Q1. Order priority", "Q2. Total price", "Status", "Order date"),
    "part": ("Brand", "Type", "Type (2)", "Size", "Price", "Name"),
    "documents": ("Lang", "Source", "Length"),
}


def _profiled(spark, sf) -> DataFrame:
    """Columns of four tables as the string cells of four surveys."""
    events = table_responses(
        heavy(spark, sf, "events"), c("event_id"),
        [F.concat_ws(", ", "event_type", F.when(c("value") > 10, "big")), money("value"), c("props"), c("user_id")],
        "events",
    )
    orders = _orders(
        spark, sf, c("o_orderpriority"), F.concat(money("o_totalprice"), lit("円")),
        F.when(c("o_orderstatus") == "P", "-").otherwise(c("o_orderstatus")),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    part = table_responses(
        heavy(spark, sf, "part"), c("p_partkey"),
        [c("p_brand"), c("p_type"), lit(""), c("p_size"), money("p_retailprice"), c("p_name")], "part",
    )
    docs = table_responses(
        heavy(spark, sf, "documents"), c("doc_id"), [c("lang"), c("source"), c("n_chars")], "documents"
    )
    return events.unionByName(orders).unionByName(part).unionByName(docs)


_COUNTERS = ("filled", "multiline", "parsed", "split_rows", "distinct_values", "distinct_tokens")


def q_infer_kind(spark, sf):
    """Kind, chart and deciding counters of every column of four tables."""
    return infer_kinds(_profiled(spark, sf)).select("survey_id", "col_idx", *_COUNTERS, "kind", "chart")


def q_infer_kind_text(spark, sf):
    """The same over whole documents, conversation turns and raw pages."""
    docs = table_responses(heavy(spark, sf, "documents"), c("doc_id"), [c("text")], "documents")
    talk = table_responses(
        heavy(spark, sf, "conversations"), c("conv_id") * 4096 + c("turn"), [c("role"), c("text")], "conversations"
    )
    pages = table_responses(heavy(spark, sf, "pages"), c("page_id"), [c("url"), c("html")], "pages")
    r = docs.unionByName(talk).unionByName(pages)
    return infer_kinds(r).select("survey_id", "col_idx", *_COUNTERS, "kind", "chart")


_SHOP_PROFILES = (
    Profile("price", "価格", "single", "bar", "preset", ("totalprice",), unit="円"),
    Profile("priority", "優先度", "single", "pie", "count", ("orderpriority", "order")),
    Profile("type", "種類", "multiple", "hbar", "count", ("eventtype",)),
    Profile("user", "利用者", "ignore", "none", "count", identity="worker-id"),
    Profile("length", "長さ", "free", "none", "count"),
)


def _shop_columns(spark) -> DataFrame:
    rows = [
        (sid, i, h, "single" if h == "Size" else None)
        for sid, headers in _HEADERS.items()
        for i, h in enumerate(headers)
    ]
    return spark.createDataFrame(rows, "survey_id string, col_idx int, header string, forced_kind string")


def _shop_questions(spark, sf) -> DataFrame:
    return qs.build_questions(_shop_columns(spark), infer_kinds(_profiled(spark, sf)), _SHOP_PROFILES)


def q_kind_resolution(spark, sf):
    """Questions from headers, profiles, inferred and forced kinds, then overrides."""
    wishes = spark.createDataFrame(
        [("events", "user", "free", "bar"), ("part", "q6", "multiple", None), ("orders", "priority", None, "bar")],
        "survey_id string, q_key string, kind string, chart string",
    )
    questions = qs.override_questions(_shop_questions(spark, sf), wishes)
    return questions.select(
        "survey_id", "q_ord", "q_key", "header", "label", "kind", "chart", "unit", "inferred",
        F.size("delimiters").cast("bigint").alias("delimiters"),
    )


def q_default_axes(spark, sf):
    """Default cross-tab axes of each survey."""
    return ct.default_axes(_shop_questions(spark, sf), row="q3")


_PART_PROFILES = (
    Profile("ring", "Ring", "single", "bar", "count", ("red ring", "blue ring")),
    Profile("small", "small", "single", "bar", "count", ("small",)),
    Profile("economy", "economy", "single", "bar", "count", ("ring economy",)),
    Profile("widget", "widget", "single", "bar", "count"),
    Profile("exact", "exact", "single", "bar", "count", ("oldrodsmall",)),
)


def q_profile_match(spark, sf):
    """Longest contained pattern per header, exact matches first, else definition order."""
    header = F.when(
        c("p_size") > 25, F.concat(lit("Q"), c("p_partkey").cast("string"), lit(". "), c("p_name"), lit(" ("), c("p_type"), lit(")"))
    ).otherwise(F.concat(c("p_name"), lit("・"), c("p_type")))
    keys = F.array(*[lit(p.key) for p in _PART_PROFILES])
    headers = table(spark, sf, "part").select("p_partkey", header.alias("header"))
    return qs.match_profiles(headers, _PART_PROFILES).select(
        "p_partkey", F.get(keys, c("profile_ord")).alias("profile_key")
    )


# ---- layout -------------------------------------------------------------------------------


def _fold_headers() -> list[str]:
    pairs = [f"2-{i}. 特徴" for i in (1, 2, 3)]
    return ["作業ID", "作業者", "作業者ページURL", "承認日時", "1. フラグ", "", pairs[0], "", pairs[1], "", pairs[2], "", "3. 数量", ""][:13]


def _folded(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Line items written as a paired-column export and folded back."""
    headers = [("lineitem", i, h) for i, h in enumerate(_fold_headers())]
    columns = named_columns(spark.createDataFrame(headers, "survey_id string, col_idx int, header_raw string"))
    code = lambda label: F.when(label.isNull(), "").otherwise("1")
    first = F.when(c("l_linestatus") == "O", "ＯＰＥＮ")
    second = F.when(c("l_quantity") > 25, "large　order")
    third = F.when(c("l_discount") > 0.05, "OPEN").when(c("l_tax") > 0.04, "-")
    blank = lambda label: F.coalesce(label, lit(""))
    cells = [
        c("l_orderkey"), c("l_suppkey"), lit("https://example.invalid"), c("l_shipdate"),
        c("l_linenumber"), c("l_returnflag"),
        code(first), blank(first), code(second), blank(second), code(third), blank(third), c("l_quantity"),
    ]
    r = table_responses(heavy(spark, sf, "lineitem"), c("l_orderkey") * 8 + c("l_linenumber"), cells, "lineitem")
    return fold_paired(columns, r)


def q_wide_fold(spark, sf):
    """Folded cells of every line item: management, choice and free columns."""
    columns, folded = _folded(spark, sf)
    names = columns.orderBy("col_idx").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(c("col_idx").cast("string"), lit(" "), "header", lit(" "), F.coalesce("forced_kind", lit("-"))))), "; ").alias("layout"))
    return folded.select(*[F.get("cells", lit(i)).alias(f"c{i}") for i in range(7)], F.size("cells").cast("bigint").alias("width")).groupBy(
        "c2", "c3", "c4", "c5", "c6", "width"
    ).agg(F.count(lit(1)).alias("n"), F.sum(c("c0").cast("bigint")).alias("orders"), F.sum(c("c1").cast("bigint")).alias("suppliers")).join(
        F.broadcast(names)
    )


def q_fold_freq(spark, sf):
    """Frequency of the folded questions with the kinds the layout fixes."""
    _, folded = _folded(spark, sf)
    s = define_survey(
        spark, folded,
        [question("lineitem", 4, "flag", "single"), question("lineitem", 5, "features", "multiple", delimiters=["\n"])],
    )
    return fr.frequency(s).select("q_key", "rank", "label", "count", "percentage")


def q_detect_layout(spark, sf):
    """One header row per customer; which of them are paired exports."""
    bal, seg = c("c_acctbal"), c("c_mktsegment")
    headers = F.array(
        lit("作業ID"), lit("作業者"), F.when(seg == "BUILDING", "ページ").otherwise("作業者ページURL"), lit("承認日時"),
        F.when(bal > 5000, F.concat(lit("1-1. "), seg)).otherwise(F.concat(lit("1. "), seg)),
        F.when(bal < 1000, "").otherwise(c("c_name")),
    )
    raw = dealt(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").select(
        c("c_custkey").cast("string").alias("survey_id"), F.posexplode(headers).alias("col_idx", "header_raw")
    )
    return detect_layout(named_columns(raw))


def q_header_uniquify(spark, sf):
    """One header row per part: repeated names get numbers, empty ones a position."""
    words = F.split("p_name", " ")
    headers = F.concat(
        words, F.array(c("p_type"), F.concat(c("p_type"), lit(" (2)"))), words,
        F.array(c("p_type"), lit("　"), F.when(c("p_size") > 25, "").otherwise("列8")),
    )
    raw = dealt(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size").select(
        c("p_partkey").cast("string").alias("survey_id"), F.posexplode(headers).alias("col_idx", "header_raw")
    )
    return named_columns(raw).select(
        "survey_id", c("col_idx").cast("bigint").alias("col_idx"), "header", "is_empty", "renamed"
    )


# ---- delimited files ------------------------------------------------------------------------


def _exports(spark, sf) -> DataFrame:
    """One small export per part: four delimiters, two encodings, CRLF or LF, with inch marks,
    quoted line ends and delimiters, long, short and blank rows, and some quotes never closed."""
    d = F.element_at(F.array(*map(lit, (",", "\t", ";", "|"))), (c("p_size") % 4 + 1).cast("int"))
    cp932 = c("p_size") % 3 == 0
    end = F.when(c("p_size") % 2 == 0, "\r\n").otherwise("\n")
    number = F.when(cp932, F.unhex(lit("94D48D86"))).otherwise(F.unhex(lit("E795AAE58FB7")))
    bom = F.when((c("p_size") % 5 == 1) & ~cp932, F.unhex(lit("EFBBBF"))).otherwise(lit("").cast("binary"))
    key = c("p_partkey").cast("string")
    rows = F.concat(
        d, lit("name"), d, lit("note"), end,
        key, d, "p_name", d, lit('5"monitor'), end,
        key, d, lit('"'), "p_type", lit("\r\nwith "), lit('""quotes"" and '), d, lit('"'), d, lit("x"), d, lit("extra"), end,
        lit("-"), d, lit("N/A"), end,
        c("p_brand"),
    )
    opened = c("p_size") % 7 == 0
    tail = F.when(opened, F.concat(end, lit('"open'), d, "p_name")).when(c("p_size") % 5 == 0, "").otherwise(end)
    content = F.concat(bom, number, F.concat(rows, tail).cast("binary"))
    part = dealt(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return part.select(key.alias("survey_id"), content.alias("content"))


def q_sniff_delimiter(spark, sf):
    """Delimiter and encoding of every export."""
    files, _ = profile_files(content_lines(_exports(spark, sf), lines_per_split=2))
    return files.select("survey_id", "delimiter", "utf8", "ends_lf")


def q_delimited_read(spark, sf):
    """Cells of every record, each export cut into splits of two lines."""
    _, responses, _ = parse_lines(content_lines(_exports(spark, sf), lines_per_split=2))
    return responses.select("survey_id", "response_id", F.array_join("cells", "␟").alias("cells"))


def q_ragged_accounting(spark, sf):
    """Warnings of every export."""
    _, _, warnings = parse_lines(content_lines(_exports(spark, sf), lines_per_split=3))
    return warnings


def q_encoding_fallback(spark, sf):
    """Headers of every export, whichever its encoding is."""
    columns, _, _ = parse_lines(content_lines(_exports(spark, sf)))
    return columns.select("survey_id", c("col_idx").cast("bigint").alias("col_idx"), "header", "is_empty", "renamed")


def _assembled(spark, sf) -> Survey:
    """Line items as a paired platform export with year, month and work-time questions."""
    headers = [
        "作業ID", "作業者", "作業者ページURL", "承認日時", "1. フラグ", "", "2-1. 特徴", "", "2-2. 特徴", "",
        "5. 仕事を受注・開始した年", "6. 仕事を受注・開始した月", "11. 実際の作業時間",
    ]
    raw = spark.createDataFrame([("lineitem", i, h) for i, h in enumerate(headers)], "survey_id string, col_idx int, header_raw string")
    large, cheap = F.when(c("l_quantity") > 25, "大口"), F.when(c("l_discount") > 0.05, "値引")
    code = lambda label: F.when(label.isNull(), "").otherwise("1")
    hours = c("l_quantity").cast("int").cast("string")
    cells = [
        c("l_orderkey"), c("l_suppkey"), lit("https://example.invalid"), c("l_shipdate").cast("date"),
        c("l_linenumber"), c("l_returnflag"), code(large), F.coalesce(large, lit("")), code(cheap), F.coalesce(cheap, lit("")),
        F.year("l_shipdate"), F.concat(F.month("l_shipdate").cast("string"), lit("月")),
        F.concat(lit("- 作業日数：", ), c("l_linenumber").cast("string"), lit("日\n- 合計作業時間："), hours, lit("時間")),
    ]
    r = table_responses(heavy(spark, sf, "lineitem"), c("l_orderkey") * 8 + c("l_linenumber"), cells, "lineitem")
    none = spark.createDataFrame([], "survey_id string, code string, n bigint")
    return assemble(named_columns(raw), r, none)


def q_assembled_questions(spark, sf):
    """Questions of an assembled export, derived ones last, with their answers counted."""
    s = _assembled(spark, sf)
    asked = s.questions.select("survey_id", "q_key", "header", "chart", "opt_order", F.coalesce("derived.type", lit("-")).alias("derived"))
    stats = fr.all_question_stats(s, pin(interpreted_units(s)))
    return stats.join(asked, ["survey_id", "q_key"]).select(
        c("q_ord").cast("bigint").alias("q_ord"), "q_key", "header", "kind", "chart", "opt_order", "derived", "valid", "blank", "total_selections"
    )


def q_assembled_freq(spark, sf):
    """Frequencies of all questions of an assembled export, derived ones included."""
    return fr.frequency(_assembled(spark, sf)).select("q_key", "label", "count", "percentage")


# ---- cross-tabs ---------------------------------------------------------------------------


def _order_customers(spark, sf, cells: list[Column], included: Column | None = None) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return table_responses(joined, c("o_orderkey"), cells, "oc", included)


def _segment_priority(spark, sf) -> tuple[Survey, list]:
    r = _order_customers(spark, sf, [c("c_mktsegment"), _with_blanks()], c("o_orderstatus") != "P")
    s = define_survey(
        spark, r,
        [question("oc", 0, "segment", "single", order="natural", label="区分"),
         question("oc", 1, "priority", "single", order="preset", presets=["4-NOT SPECIFIED", "2-HIGH"], label="優先|度")],
    )
    return s, [("segment", "priority")]


_TIDY = ("row_rank", "row_label", "col_rank", "col_label", "count", "row_total", "col_total", "grand_total")


def q_crosstab(spark, sf):
    """Segment by priority over included orders answering both."""
    return ct.crosstab(*_segment_priority(spark, sf)).select(*_TIDY)


def q_crosstab_default_axes(spark, sf):
    """Cross-tab of the default axes of an export whose questions were built from its columns."""
    s = _assembled(spark, sf)
    made = ct.crosstab(s, ct.default_axes(s.questions))
    return made.select("row_key", "col_key", "row_label", "col_label", "count", "row_total", "col_total", "grand_total")


def q_crosstab_margins(spark, sf):
    """Multiple choice by single choice: margins are distinct respondents, not cell sums."""
    flags = _flag_cells(spark, sf)
    orders = table(spark, sf, "orders").join(flags, c("o_orderkey") == c("l_orderkey"))
    r = table_responses(orders, c("o_orderkey"), [c("cell"), c("o_orderstatus")], "s")
    s = define_survey(
        spark, r, [question("s", 0, "flag", "multiple", order="natural"), question("s", 1, "status", "single", order="natural")]
    )
    return ct.crosstab(s, [("flag", "status")]).select(*_TIDY)


def q_crosstab_pct(spark, sf):
    """Row, column and total shares of each cell."""
    tidy = ct.with_shares(ct.crosstab(*_segment_priority(spark, sf)))
    return tidy.select("row_label", "col_label", "count", "row_pct", "col_pct", "total_pct")


def q_crosstab_numeric(spark, sf):
    """Status by binned price; bins come from all included orders."""
    cell = F.when(c("o_orderpriority") == "5-LOW", "不明").otherwise(F.concat(money("o_totalprice"), lit("円")))
    status = F.when(c("o_totalprice") > 400000, "").otherwise(c("o_orderstatus"))
    r = _orders(spark, sf, status, cell)
    s = define_survey(
        spark, r,
        [question("orders", 0, "status", "single", order="natural"),
         question("orders", 1, "price", "numeric", unit="円", order="natural")],
    )
    return ct.crosstab(s, [("status", "price")]).select(*_TIDY)


def q_crosstab_all_pairs(spark, sf):
    """Every ordered pair of four questions in one aggregation."""
    year = F.year("o_orderdate").cast("string")
    r = _order_customers(spark, sf, [c("o_orderstatus"), _with_blanks(), c("c_mktsegment"), year])
    keys = ("status", "priority", "segment", "year")
    s = define_survey(spark, r, [question("oc", i, k, "single", order="natural") for i, k in enumerate(keys)])
    return ct.mirrored(ct.crosstab(s, ct.all_pairs(s))).drop("survey_id")


def q_crosstab_bitmaps(spark, sf):
    """All pairs of eight questions from one bitmap index of the responses."""
    year, month = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    cells = [c("o_orderstatus"), _with_blanks(), c("c_mktsegment"), year, month]
    cells += [c("c_nationkey").cast("string"), F.quarter("o_orderdate").cast("string"), F.dayofweek("o_orderdate").cast("string")]
    r = _order_customers(spark, sf, cells)
    keys = ("status", "priority", "segment", "year", "month", "nation", "quarter", "weekday")
    s = define_survey(spark, r, [question("oc", i, k, "single", order="natural") for i, k in enumerate(keys)])
    return bm.crosstab_of_many(s, ct.all_pairs(s)).drop("survey_id", "row_rank", "col_rank")


def q_crosstab_dense(spark, sf):
    """Dense matrix of nation key by brand-like label, zeros included."""
    big = F.when(c("c_acctbal") > 9000, F.concat(lit("big "), c("c_mktsegment"))).otherwise(c("c_mktsegment"))
    r = table_responses(table(spark, sf, "customer"), c("c_custkey"), [c("c_nationkey"), big], "s")
    s = define_survey(
        spark, r, [question("s", 0, "nation", "single", order="natural"), question("s", 1, "segment", "single", order="natural")]
    )
    return ct.dense(ct.crosstab(s, [("nation", "segment")])).select(*_TIDY)


def _lines(df: DataFrame) -> DataFrame:
    return df.select("section", "position", "part", "line")


def q_crosstab_csv(spark, sf):
    """Lines of the cross-tab CSV."""
    s, pairs = _segment_priority(spark, sf)
    return _lines(rp.crosstab_csv(s, ct.crosstab(s, pairs), pairs))


def q_crosstab_markdown(spark, sf):
    """Lines of the Markdown cross-tab in row-share mode."""
    s, pairs = _segment_priority(spark, sf)
    return _lines(rp.crosstab_markdown(s, ct.crosstab(s, pairs), pairs, "row"))


# ---- rows, columns and policy -------------------------------------------------------------


def _customers(spark, sf) -> DataFrame:
    note = F.concat_ws(" / ", "c_name", "c_mktsegment", c("c_nationkey").cast("string"), money("c_acctbal"))
    return table_responses(
        table(spark, sf, "customer"), c("c_custkey"),
        [c("c_name"), c("c_mktsegment"), note, F.concat(money("c_acctbal"), lit(', "yen"'))], "customer",
    )


def _customer_questions() -> list[tuple]:
    return [
        question("customer", 0, "worker-name", "ignore", header="作業者", identity="worker-name"),
        question("customer", 1, "segment", "single", header="segment"),
        question("customer", 2, "note", "free", header="note"),
        question("customer", 3, "balance", "ignore", header="残高, 円", identity="approved-at"),
    ]


def q_search_exclude(spark, sf):
    """Responses matching a search are excluded; the rest is counted."""
    off = po.set_included(_customers(spark, sf), False, matching=" customer#0000000 ")
    off = po.set_included(off, False, matching="/ 1")
    return _items(_freq(spark, off, *_customer_questions()))


def q_exclusion_overlay(spark, sf):
    """A table of single decisions is laid over the responses."""
    overlay = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        lit("orders").alias("survey_id"), c("o_orderkey").alias("response_id"), lit(False).alias("included")
    )
    r = po.apply_exclusions(_orders(spark, sf, c("o_orderpriority")), overlay)
    return _items(_freq(spark, r, question("orders", 0, "priority", "single")))


def q_frequency_after_edits(spark, sf):
    """Two rounds of decisions on kept units; option labels follow the earliest order that is left."""
    spelled = F.when(c("o_totalprice") > 150000, F.lower("o_orderpriority")).otherwise(c("o_orderpriority"))
    both = F.concat_ws("、", c("o_orderstatus"), spelled)
    r = _orders(spark, sf, spelled, both, included=c("o_orderstatus") != "P")
    questions = [question("orders", 0, "priority", "single"), question("orders", 1, "both", "multiple")]

    def decided(condition: str, included: bool) -> DataFrame:
        return table(spark, sf, "orders").where(condition).select(
            lit("orders").alias("survey_id"), c("o_orderkey").alias("response_id"), lit(included).alias("included")
        )

    kept = up.keep(define_survey(spark, r, questions))
    kept = up.edit(kept, decided("o_totalprice < 160000", False))
    back = decided("o_orderstatus = 'P' AND o_totalprice >= 300000 OR o_totalprice < 20000", True)
    kept = up.edit(kept, back)
    return up.kept_frequency(kept).select("q_key", "rank", "label", "count", "percentage")


def q_response_counters(spark, sf):
    r = _orders(spark, sf, c("o_orderpriority"), money("o_totalprice"), included=c("o_totalprice") > 1000 * 50, sid=c("o_orderstatus"))
    return po.response_counters(r, "77")


def _listed(df: DataFrame) -> DataFrame:
    cells = [F.get("cells", lit(i)).alias(f"cell{i}") for i in range(4)]
    return df.select("no", "included", *cells)


def q_listing_page(spark, sf):
    """First matches with hidden identity cells dropped and long cells shortened."""
    s = define_survey(spark, po.set_included(_customers(spark, sf), False, "house"), _customer_questions())
    return _listed(po.listing_page(s.responses, po.hidden_columns(s.questions), "BUILD", s.traits.rows))


def q_identity_mask(spark, sf):
    """All responses without the hidden identity cell."""
    s = define_survey(spark, _customers(spark, sf), _customer_questions())
    return _listed(rp.audit_rows(s, po.hidden_columns(s.questions)))


def q_identity_columns(spark, sf):
    """Identity columns per nation-wide survey of customers, first of each kind."""
    ids = table(spark, sf, "customer").select(c("c_custkey").cast("string").alias("survey_id"), "c_acctbal")
    rows = ids.select(
        "survey_id",
        F.posexplode(
            F.array(
                F.when(c("c_acctbal") > 0, "approved-at"), lit(None).cast("string"), lit("worker-id"),
                lit("worker-name"), F.when(c("c_acctbal") > 5000, "worker-id"),
            )
        ).alias("q_ord", "identity"),
    )
    q = rows.select(
        "survey_id", "q_ord", "identity", c("q_ord").alias("col_idx"), F.concat(lit("q"), c("q_ord").cast("string")).alias("q_key"),
        lit("h").alias("header"), lit("l").alias("label"),
    )
    return po.identity_questions(q).select(
        "survey_id", c("position").cast("bigint").alias("position"), "identity", c("col_idx").cast("bigint").alias("col_idx")
    )


def q_audit_export(spark, sf):
    """Lines of the audit CSV: all responses, flag at the end, identity by visibility."""
    r = po.set_included(_customers(spark, sf), False, "machinery")
    s = define_survey(spark, r, _customer_questions())
    s = s.with_(columns=s.questions.select("survey_id", "col_idx", "header"))
    return _lines(rp.audit_csv(s, po.hidden_columns(s.questions)))


# ---- whole-survey results -----------------------------------------------------------------


def _mixed_survey(spark, sf) -> Survey:
    """Choice, numeric and free questions of two surveys, one question not selected."""
    orders = _orders(
        spark, sf, _with_blanks(), F.concat_ws("、", c("o_orderstatus"), F.when(c("o_totalprice") > 250000, "large")),
        F.concat(money("o_totalprice"), lit("円")), lit("-"), included=c("o_totalprice") > 5000,
    )
    # Labels with a bar and a line end, as reports have to escape them.
    lang = F.concat(c("lang"), lit(' | "a"\nb'))
    docs = table_responses(table(spark, sf, "documents"), c("doc_id"), [lang, c("text"), c("source")], "documents")
    return define_survey(
        spark,
        orders.unionByName(docs),
        [
            question("orders", 0, "priority", "single", label="優先度", chart="pie"),
            question("orders", 1, "status", "multiple", label="状態|区分"),
            question("orders", 2, "price", "numeric", label="価格", unit="円"),
            question("orders", 3, "none", "single", label="無回答"),
            question("documents", 0, "lang", "single", label="言語, lang"),
            question("documents", 1, "text", "free", label="本文"),
            question("documents", 2, "source", "single", label="出典", order="natural", selected=False),
        ],
    )


def q_summary_rows(spark, sf):
    """Rows of summary.csv; questions without items keep one row."""
    return rp.summary_rows(analyze(_mixed_survey(spark, sf))).withColumn("rank", c("rank").cast("bigint"))


def q_summary_csv(spark, sf):
    """Lines of summary.csv."""
    return rp.summary_csv(analyze(_mixed_survey(spark, sf)))


def q_written_csv(spark, sf):
    """summary.csv of one survey as written for spreadsheet programs, read back as bytes."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    rp.write_lines(rp.summary_csv(analyze(_mixed_survey(spark, sf))).where("survey_id = 'orders'"), folder, bom=True, line_sep="\r\n")
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    lines = F.split(F.decode("content", "UTF-8"), "\r\n")
    # Every line is ended, so the last piece of a part is empty.
    return parts.select(F.explode(F.slice(lines, lit(1), F.size(lines) - 1)).alias("line"))


def q_report_lines(spark, sf):
    """The whole Markdown summary; only its time stamp is replaced."""
    lines = rp.summary_markdown(analyze(_mixed_survey(spark, sf)))
    return lines.withColumn("line", F.regexp_replace("line", "^(- 生成日時: ).*", "$1now"))


def q_analysis_json(spark, sf):
    """The nested result, written as JSON, read back and flattened to its items."""
    docs = analysis_documents(analyze(_mixed_survey(spark, sf)))
    as_json = docs.select(F.to_json("document").alias("j"))
    parsed = as_json.select(F.from_json("j", docs.schema["document"].dataType).alias("d"))
    asked = parsed.select(
        c("d.sourceName").alias("source"), c("d.totalResponses").alias("total"), c("d.includedResponses").alias("included"),
        F.posexplode("d.questions").alias("q_ord", "q"),
    )
    return asked.select(
        "source", "total", "included", c("q_ord").cast("bigint").alias("q_ord"), c("q.key").alias("q_key"), "q.kind",
        c("q.validResponses").alias("valid"), c("q.totalSelections").alias("selections"), c("q.numeric.median").alias("median"),
        c("q.question").alias("question"), c("q.multiple").alias("multiple"), c("q.blankResponses").alias("blank"),
        F.array_join(F.transform("q.items", lambda i: F.concat(
            i["label"], lit("="), i["count"].cast("string"), lit("="), F.format_string("%.2f", i["percentage"]))), " ; ").alias("items"),
        F.coalesce(F.array_join("q.freeTextSamples", " ; "), lit("-")).alias("samples"),
    )


def q_column_report(spark, sf):
    """What was recognised per column with the number of options found."""
    s = _shop_survey(spark, sf)
    return qs.column_report(s.questions, fr.frequency_totals(fr.frequency(s))).withColumn("q_ord", c("q_ord").cast("bigint"))


def q_chart_series(spark, sf):
    """Chart-ready series of questions with a chart."""
    s = _shop_survey(spark, sf)
    return qs.chart_series(fr.frequency(s), s.questions)


def q_selection(spark, sf):
    """Overlays on questions: one deselected, one changed to multiple choice."""
    s = _shop_survey(spark, sf)
    off = spark.createDataFrame([("part", "name", False)], "survey_id string, q_key string, selected boolean")
    wish = spark.createDataFrame([("part", "brand", "multiple", None)], "survey_id string, q_key string, kind string, chart string")
    questions = pin(qs.override_questions(qs.select_questions(s.questions, off), wish))
    changed = s.with_(questions=questions, traits=traits_of(questions))
    return fr.frequency(changed).drop("opt_key")


def q_split_answers(spark, sf):
    """Distinct answers of every part label, as a cell-level function."""
    cell = F.concat(c("p_name"), lit("／"), c("p_type"), lit("｜"), c("p_type"), lit("\r\n【a、"), c("p_brand"), lit("】"))
    safe = F.array(*[lit(d) for d in SAFE_DELIMITERS])
    parts = answers.split_answers(cell, safe)
    return table(spark, sf, "part").select("p_partkey", F.array_join(parts, " # ").alias("answers"))


def q_work_functions(spark, sf):
    """Days and minutes read from each work-time cell."""
    t = text.norm_text(_work_cell())
    return (
        heavy(spark, sf, "lineitem")
        .select(worktime.work_days(t).alias("days"), worktime.work_minutes(t).alias("minutes"))
        .groupBy("days", "minutes")
        .agg(F.count(lit(1)).alias("n"))
    )


QUERIES = {name: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
