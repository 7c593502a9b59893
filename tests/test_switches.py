"""Settings that only choose a plan: both sides give the same rows on the same data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import model
from tallyweave.functions import answers
from tallyweave.functions.text import protect, restore, shorten_long, is_blank
from tallyweave.model import question, question_table
from tallyweave.operators import crosstab as ct, inference, joins, numeric, policy
from tallyweave.operators.frequency import frequency
from tallyweave.operators.ranking import ranked
from tallyweave.session import spread
from tests.test_analysis import RESPONSES, survey_of


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dimension_join(spark, how):
    facts = spark.createDataFrame([(f"k{i % 3}" if i % 7 else None, i) for i in range(200)], "k string, v bigint")
    dim = spark.createDataFrame([("k0", "a"), ("k1", "b"), ("k9", "c")], "k string, label string")
    small = joins.dim_join(facts, dim, ["k"], "v", rows=3, how=how)
    assert rows(small) == rows(joins.dim_join(facts, dim, ["k"], "v", rows=joins.BROADCAST_ROWS + 1, how=how))
    assert rows(small) == rows(joins.dim_join(facts, dim, ["k"], "v", how=how))


def test_ranks(spark):
    data = spark.createDataFrame([(f"g{i % 3}", (i * 7919) % 1009, i) for i in range(900)], "g string, v bigint, i bigint")
    order = [F.col("v").desc(), F.col("i").asc()]
    assert rows(ranked(data, ["g"], order)) == rows(ranked(data, ["g"], order, max_group=10, partitions=7))


def test_short_and_long_cells(spark, monkeypatch):
    cells = [["a、b", "x" * 70 + " 5", ""], ["b; a", "「長、い」" * 12, "-"], ["-", "y", "1"], ["a\nb", "x" * 70 + " 5", "2"]] * 3
    responses = spark.createDataFrame([("s", i, True, c) for i, c in enumerate(cells)], RESPONSES)
    usual = rows(inference.column_profile(responses))
    for length in (0, 3, 10_000):
        monkeypatch.setattr(inference, "SHORT_CELL", length)
        assert rows(inference.column_profile(responses)) == usual


def test_literal_question_rows(spark, monkeypatch):
    listed = [question("s", i, f"q{i}", "single", presets=["a", "b"], aliases={"x": "a"}) for i in range(4)]
    usual = rows(question_table(spark, listed)[0])
    monkeypatch.setattr(model, "MAX_LITERAL_ROWS", 0)
    assert rows(question_table(spark, listed)[0]) == usual


def mixed(spark):
    asked = [
        question("s", 0, "a", "single", order="natural"), question("s", 1, "b", "multiple"),
        question("s", 2, "n", "numeric", unit="円"), question("s", 3, "f", "free"),
    ]
    cells = [[f"v{i % 4}", f"p{i % 3}、p{i % 5}", f"{i * 130}円" if i % 6 else "-", "text"] for i in range(60)]
    return survey_of(spark, asked, cells, excluded={3})


def test_hand_written_questions_and_question_tables(spark):
    s = mixed(spark)
    table = s.with_(questions=s.questions)
    assert s.rows and table.rows is None
    assert rows(frequency(s)) == rows(frequency(table))
    listed = [("a", "b"), ("b", "n"), ("n", "a")]
    pairs = spark.createDataFrame([("s", *p) for p in listed], "survey_id string, row_key string, col_key string")
    assert rows(ct.crosstab(s, listed)) == rows(ct.crosstab(table, pairs))


def test_many_pairs_and_many_cells(spark, monkeypatch):
    s = mixed(spark)
    table = s.with_(questions=s.questions)
    usual = rows(ct.crosstab(table, ct.all_pairs(table)))
    monkeypatch.setattr(ct, "SPEC_PAIRS", 1)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ct, "BROADCAST_ROWS", 0)
    assert rows(ct.crosstab(table, ct.all_pairs(table))) == usual


def test_exclusions(spark, monkeypatch):
    s = mixed(spark)
    overlay = spark.createDataFrame([("s", 1, False), ("s", 3, True), ("t", 5, False)], "survey_id string, response_id bigint, included boolean")
    usual = rows(policy.apply_exclusions(s.responses, overlay))
    monkeypatch.setattr(policy, "OVERLAY_BROADCAST_ROWS", 0)
    assert rows(policy.apply_exclusions(s.responses, overlay)) == usual


def test_spread_scan(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert spread(scan).rdd.getNumPartitions() > 1 and rows(spread(scan)) == rows(scan)


def test_shortened_answers_keep_the_blank_test(spark):
    texts = ["", "-", " " * 80, "　" * 70 + "-", "n/a" + " " * 70, "x" * 70, " " * 64 + "x", "undefined", "undefinedx", "－", "ｎ／ａ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(is_blank(F.col("t")).alias("a"), is_blank(shorten_long(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and [r.a for r in got] == [True] * 5 + [False, False, True, False, True, True]


def test_internal_separator_in_input(spark):
    odd = ["a﷐b", "﷒", "﷒0、﷐", "x﷒2y"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r[0] for r in df.select(restore(protect(F.col("t")))).collect()] == odd
    safe = F.array(F.lit("、"))
    got = [r[0] for r in df.select(answers.split_answers(F.col("t"), safe)).collect()]
    assert got == [["a﷐b"], ["﷒"], ["﷒0", "﷐"], ["x﷒2y"]]
    s = survey_of(spark, [question("s", 0, "a", "single")], [[t] for t in odd])
    assert sorted(r.label for r in frequency(s).collect()) == sorted(odd)


@pytest.mark.parametrize("base", [1.7e12, -3.0e9, 0.0, 123456.0])
def test_order_statistics_of_values_with_equal_heads(spark, base):
    random = np.random.default_rng(4)
    values = np.unique(base + random.integers(0, 90_000, 4_000).astype(float) / 8)
    counts = random.integers(1, 4, len(values))
    df = spark.createDataFrame([("s", "q", float(v), int(c)) for v, c in zip(values, counts)], "survey_id string, q_key string, value double, c bigint")
    got = numeric.order_statistics(df).first()
    every = np.repeat(values, counts)
    n = len(every)
    at = lambda i: every[int(i)]
    assert (got.p25, got.p75) == (at(min(n - 1, n // 4)), at(min(n - 1, n * 3 // 4)))
    low, high = at((n - 1) // 2), at(n // 2)
    assert got.median == pytest.approx((low + high) / 2, rel=1e-11)
