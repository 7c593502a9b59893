from pyspark.sql import functions as F

from tallyweave.model import question
from tallyweave.operators import crosstab as ct
from tests.test_analysis import survey_of


def pairs(spark, *ps):
    return spark.createDataFrame([("s", a, b) for a, b in ps], "survey_id string, row_key string, col_key string")


def matrix(spark, survey, row, col):
    t = ct.crosstab(survey, pairs(spark, (row, col)))
    rows = ct.dense(t).orderBy("row_rank", "col_rank").collect()
    labels = list(dict.fromkeys(r["row_label"] for r in rows))
    cols = list(dict.fromkeys(r["col_label"] for r in rows))
    counts = [[r["count"] for r in rows if r["row_label"] == l] for l in labels]
    rt = [next(r["row_total"] for r in rows if r["row_label"] == l) for l in labels]
    ctot = [next(r["col_total"] for r in rows if r["col_label"] == l) for l in cols]
    return labels, cols, counts, rt, ctot, rows[0]["grand_total"]


def test_single_by_single(spark):
    qs = [question("s", 0, "age", "single", order="natural"), question("s", 1, "score", "single")]
    rows = [["20代", "良い"], ["20代", "悪い"], ["30代", "良い"], ["30代", "良い"], ["", "良い"], ["20代", "-"]]
    got = matrix(spark, survey_of(spark, qs, rows), "age", "score")
    assert got == (["20代", "30代"], ["良い", "悪い"], [[1, 1], [2, 0]], [2, 2], [3, 1], 4)


def test_multiple_by_single_margins(spark):
    qs = [question("s", 0, "ai", "multiple"), question("s", 1, "age", "single", order="preset", presets=["20代", "30代"])]
    rows = [["A、B", "20代"], ["A", "20代"], ["A,B", "30代"], ["A", "30代"], ["b", "30代"], ["", "30代"], ["A", ""]]
    s = survey_of(spark, qs, rows)
    labels, cols, counts, rt, ctot, grand = matrix(spark, s, "ai", "age")
    assert (labels, cols, grand) == (["A", "B"], ["20代", "30代"], 5)
    assert counts == [[2, 2], [1, 2]] and rt == [4, 3] and ctot == [2, 3]
    text = ct.dense(ct.crosstab(s, pairs(spark, ("ai", "age")))).select(
        "row_rank", "col_rank", *[ct.cell_text(m).alias(m) for m in ct.MODES]).orderBy("row_rank", "col_rank").first()
    assert (text["count"], text["row"], text["col"], text["total"]) == ("2", "2 (50.0%)", "2 (100.0%)", "2 (40.0%)")


def test_numeric_axis_uses_all_included_rows(spark):
    qs = [question("s", 0, "pay", "numeric", unit="円", order="natural"), question("s", 1, "g", "single")]
    rows = [[f"{i * 1000}円", "x" if i % 2 else "y"] for i in range(21)] + [["不明", "x"], ["99", ""]]
    s = survey_of(spark, qs, rows, excluded={5})
    labels, cols, counts, rt, ctot, grand = matrix(spark, s, "pay", "g")
    assert grand == 20 and sum(rt) == 20 and labels[0].startswith("0〜") and sum(ctot) == 20


def test_all_pairs_mirror_and_ineligible(spark):
    qs = [question("s", 0, "a", "single"), question("s", 1, "b", "multiple"), question("s", 2, "f", "free"),
          question("s", 3, "c", "single", selected=False)]
    rows = [["x", "1、2", "t", "p"], ["y", "2", "t", "q"], ["x", "", "t", "p"]]
    s = survey_of(spark, qs, rows)
    got = ct.mirrored(ct.crosstab(s, ct.all_pairs(s)))
    keys = {(r["row_key"], r["col_key"]) for r in got.collect()}
    assert keys == {(a, b) for a in "abc" for b in "abc" if a != b}
    assert ct.crosstab(s, pairs(spark, ("a", "f"), ("a", "zz"))).count() == 0
    row = got.where("row_key='b' and col_key='a' and row_label='2' and col_label='x'").first()
    assert (row["count"], row["row_total"], row["col_total"], row["grand_total"]) == (1, 2, 1, 2)


def test_default_axes(spark):
    qs = [question("s", 0, "f", "free"), question("s", 1, "a", "single"), question("s", 2, "gender", "single"),
          question("s", 3, "ai-tools", "multiple")]
    s = survey_of(spark, qs, [["", "", "", ""]])
    pick = lambda *a: tuple(ct.default_axes(s.questions, *a).first())[1:]
    assert pick() == ("gender", "ai-tools")
    assert pick("a", "a") == ("a", "gender")
    assert pick("f", "gender") == ("gender", "a")


def test_listed_pairs_equal_pair_table(spark):
    qs = [question("s", 0, "a", "single"), question("s", 1, "b", "multiple"), question("s", 2, "n", "numeric"),
          question("s", 3, "ym", "single", derived=("year-month", 2, 0, None))]
    rows = [["1", "p、q", "2024"], ["2", "q", "24"], ["1", "", "x"], ["2", "p", "7"]]
    s = survey_of(spark, qs, rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ct.crosstab(s, ct.all_pairs(s))) == key(ct.crosstab(s, ct.pair_table(s, ct.all_pairs(s))))
    assert key(ct.pair_table(s, ct.all_pairs(s))) == key(ct.all_pairs(s.with_(rows=None)))
    assert ct.crosstab(s, [("a", "zz")]).count() == 0
