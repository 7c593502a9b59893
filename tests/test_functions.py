import itertools
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.constants import DEFAULT_DELIMITERS, SAFE_DELIMITERS
from tallyweave.functions import answers, numbers, text, worktime
from tests.conftest import column


def delims(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def test_inert_ranges_are_stable_under_nfkc():
    chars = [chr(c) for a, b in text.INERT_RANGES for c in range(a, b + 1)]
    assert all(unicodedata.normalize("NFKC", ch) == ch for ch in chars)
    assert all(unicodedata.combining(ch) == 0 for ch in chars)
    sample = chars[:400] + chars[400::97]
    joined = "".join(a + b for a, b in itertools.product(sample[::5], sample[::7]))
    assert unicodedata.normalize("NFKC", joined) == joined


def test_norm_text(spark):
    cases = {
        "　ＣｈａｔＧＰＴ　": "ChatGPT",
        "a\r\nb\rc": "a\nb\nc",
        " a  b \n  c ": "a b\nc",
        "ｶﾞｲﾄﾞ": "ガイド",
        "é": "é",
        "…": "...",
        "a b": "a b",
        "": "",
    }
    assert column(spark, cases, text.norm_text) == list(cases.values())


@settings(max_examples=3, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.lists(st.text(max_size=12), min_size=200, max_size=200))
def test_nfkc_equals_unicodedata(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    got = column(spark, values, text.nfkc)
    assert got == [unicodedata.normalize("NFKC", v) for v in values]


def test_keys_and_blanks(spark):
    assert column(spark, ["AI。", "Ａ．", "x,.、", "。"], text.norm_key) == ["ai", "a", "x", ""]
    assert column(spark, ["Q3. 現在の職種を、教えてください？", " A-B【c】"], text.norm_header) == [
        "q3現在の職種を教えてください",
        "abc",
    ]
    blanks = ["", "  ", "　", "-", "－", "‐", "—", "N/A", "ｎ/a", "NULL", "Undefined", None, " - "]
    answers_ = ["なし", "0", "ー", "特になし", "n a", "undefined!", "- - - - - - - - - - -"]
    assert column(spark, blanks, text.is_blank) == [True] * len(blanks)
    assert column(spark, answers_, text.is_blank) == [False] * len(answers_)


def test_natural_order(spark):
    values = ["10代", "9代", "1,000円", "200円", "2024-12", "2024-03", "Brand#10", "Brand#2", "あ", "ア"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r.s for r in df.orderBy(*text.natural_order(F.col("s"))).collect()]
    assert got == ["9代", "10代", "200円", "1,000円", "2024-03", "2024-12", "Brand#2", "Brand#10", "あ", "ア"]


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("ChatGPT、Claude", ["ChatGPT", "Claude"]),
        ("A；B｜C|D;E", ["A", "B", "C", "D", "E"]),
        ("A\r\nB\rC", ["A", "B", "C"]),
        ("  ChatGPT 、 ＣＬＡＵＤＥ  ", ["ChatGPT", "CLAUDE"]),
        ("A/B・C", ["A/B・C"]),
        ("A，B", ["A,B"]),
        ("その他（AAA、BBB）、ChatGPT", ["その他(AAA、BBB)", "ChatGPT"]),
        ("その他(X,Y),Z", ["その他(X,Y)", "Z"]),
        ("【A、B】、C", ["【A、B】", "C"]),
        ("その他（A（B、C）、D）、E", ["その他(A(B、C)、D)", "E"]),
        ("その他（A\nB）\nC", ["その他(A\nB)", "C"]),
        ("A）、B", ["A)", "B"]),
        ("（A、B", ["(A、B"]),
        ('"A、B",C', ["A、B", "C"]),
        ('"ChatGPT"、Claude', ["ChatGPT", "Claude"]),
        ("“ChatGPT”、Claude", ["ChatGPT", "Claude"]),
        ('5"モニタ、A', ['5"モニタ', "A"]),
        ("", []),
        ("、、、", []),
        ("A、、B、 、-、N/A、C", ["A", "B", "C"]),
        ("なし、0", ["なし", "0"]),
        ("ChatGPT、chatgpt、ＣｈａｔＧＰＴ", ["ChatGPT"]),
        ("AI、AI。", ["AI"]),
        ("A\nB\nA\nB\nC", ["A", "B", "C"]),
    ],
)
def test_split_answers(spark, cell, expected):
    got = column(spark, [cell], lambda c: answers.split_answers(c, delims(SAFE_DELIMITERS)))
    assert got == [expected]


def test_split_answers_other_delimiters(spark):
    wide = column(spark, ["A/B・C"], lambda c: answers.split_answers(c, delims(DEFAULT_DELIMITERS)))
    none = column(spark, ["A、B\nC"], lambda c: answers.split_answers(c, delims(())))
    assert wide == [["A", "B", "C"]] and none == [["A、B\nC"]]


NUMBERS = [
    ("12,000円", None, 12000), ("1万円", None, 10000), ("1.5万円", None, 15000),
    ("3万5000円", None, 35000), ("10万", None, 100000), ("約5000円", None, 5000),
    ("3時間", None, 3), ("30分", "時間", 0.5), ("3h", None, 3), ("0", None, 0),
    ("3〜5", None, 4), ("3～5", None, 4), ("3から5", None, 4), ("5000円以上", None, 5000),
    ("１２０００円", None, 12000), ("３万５０００円", None, 35000), ("", None, None),
    ("なし", None, None), ("-", None, None), ("1,234,567円", None, 1234567),
    ("5,001〜10,000円", None, 7500.5), ("1〜3万円", None, 20000),
    ("1万円〜3万円未満", None, 20000), ("90分", "時間", 1.5), ("1時間30分", "時間", 1.5),
    ("3h", "時間", 3), ("2024-01", None, 2024), ("2024年", None, 2024), ("〜5,000円", None, 5000),
    ("-5", None, -5), ("2023-2024", None, 2023.5), ("5千3万", None, 5000), ("1億2千", None, 100002000),
    ("3万4万", None, 30000), ("a-3-5", None, 4), ("2024年1〜3月", None, 2024), ("3,5", None, 3),
]


@pytest.mark.parametrize("unit", [None, "時間"])
def test_parse_number(spark, unit):
    cases = [(s, v) for s, u, v in NUMBERS if u == unit]
    unit_col = F.lit(unit).cast("string")
    got = column(spark, [s for s, _ in cases], lambda c: numbers.parse_number(c, unit_col))
    assert dict(zip([s for s, _ in cases], got)) == dict(cases)


def test_number_display(spark):
    df = spark.createDataFrame(
        [(12.25, 1, "12.3"), (12.35, 1, "12.3"), (0.0, 1, "0.0"), (1234567.0, 0, "1,234,567"),
         (-1234.5, 1, "-1,234.5"), (-0.01, 1, "0.0"), (999.0, 0, "999"), (1234.5678, 4, "1,234.5678")],
        "v double, d int, e string",
    )
    rows = df.select(numbers.display(F.col("v"), F.col("d")).alias("g"), "e").collect()
    assert [r.g for r in rows] == [r.e for r in rows]
    assert spark.range(1).select(numbers.tidy(F.lit(0.1) + F.lit(0.2))).first()[0] == 0.3


DAYS = {
    "1日": 1, "１日": 1, "一日": 1, "10日": 10, "- 作業日数：1日\n- 合計作業時間：3時間": 1,
    "- 作業日数:　1日\n- 合計作業時間:10分": 1, "作業日数:2\n合計作業時間:8": 2, "半日以下": None,
    "作業日数:3週間": None, "約8時間": None, "1日〜2日": None, "0日": None, "作業日数:0": None,
    "約3日ほど": 3, "2": None, "03日": 3, "1日\n2日": None,
}
MINUTES = {
    "30分": 30, "3時間": 180, "5時間30分": 330, "1時間半": 90, "1時間半程": 90, "約3時間": 180,
    "6時間ほど": 360, "３０分": 30, "- 作業日数：3日\n- 合計作業時間：5時間30分": 330, "8": None,
    "合計作業時間:16": None, "応募に1分、作業に3分": None, "1時間90分": None, "": None,
}


def test_work_time(spark):
    days = column(spark, DAYS, lambda c: worktime.work_days(text.norm_text(c)))
    minutes = column(spark, MINUTES, lambda c: worktime.work_minutes(text.norm_text(c)))
    assert dict(zip(DAYS, days)) == DAYS and dict(zip(MINUTES, minutes)) == MINUTES
    assert column(spark, ["", "  ", "-", "3日"], worktime.work_days_cell) == ["", "", "解析不能", "3日"]
    bounds = ["5分", "29分", "30分", "60分", "120分", "180分", "299分", "300分", "599分", "600分", "1199分", "1200分", "8"]
    assert column(spark, bounds, worktime.work_minutes_cell) == [
        "30分未満", "30分未満", "30分~1時間未満", "1~2時間未満", "2~3時間未満", "3~5時間未満", "3~5時間未満",
        "5~10時間未満", "5~10時間未満", "10~20時間未満", "10~20時間未満", "20時間以上", "解析不能",
    ]


def test_year_month(spark):
    rows = [("2024", "1月", "2024-01"), ("24年", "12", "2024-12"), ("2024", "13月", ""),
            ("", "3月", ""), ("2024", "", ""), ("2023-2024", "1", "2023.5-01"), ("2024", "1.5", "")]
    df = spark.createDataFrame(rows, "y string, m string, e string")
    got = df.select(worktime.year_month_cell(F.col("y"), F.col("m")).alias("g"), "e").collect()
    assert [r.g for r in got] == [r.e for r in got]
