"""Kept units after any sequence of edits against statistics of all responses."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.model import define_survey, question
from tallyweave.operators import frequency as fr, policy as po, upkeep as up
from tallyweave.operators.units import interpreted_units
from tallyweave.session import pin
from tests.test_analysis import RESPONSES

DECISIONS = "survey_id string, response_id bigint, included boolean"


def some_survey(spark, n=120, surveys=("a", "b")):
    r = random.Random(8)
    rows = []
    for sid in surveys:
        for i in range(n):
            cells = [
                r.choice(["Yes", "YES", "yes。", "no", "", "-"]),
                "、".join(r.sample(["ChatGPT", "ＣｈａｔＧＰＴ", "Claude", "gemini"], r.randint(0, 3))),
                str(r.randint(1, 9)), r.choice(["2", "3", ""]), r.choice(["5", "", None]),
            ]
            # Ids on both sides of zero, in some fifty blocks.
            rows.append((sid, (i - 20) * 1777, r.choice([True, True, False, None]), cells))
    questions = []
    for sid in surveys:
        questions += [
            question(sid, 0, "said", "single"), question(sid, 1, "tools", "multiple"), question(sid, 2, "score", "numeric"),
            question(sid, 3, "worked", "single", derived=("year-month", 3, 4, None)),
            question(sid, 4, "left out", "single", selected=False),
        ]
    return define_survey(spark, spark.createDataFrame(rows, RESPONSES), questions)


def collected(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def same(kept, survey, tables=False):
    whole = interpreted_units(survey)
    got, wanted = collected(up.kept_units(kept)), collected(whole)
    assert got == wanted
    if tables:
        assert collected(up.kept_frequency(kept)) == collected(fr.frequency(survey))


@pytest.mark.parametrize("pages,heads", [(7, 1), (up.PAGES, up.HEADS)])
def test_edits_as_recomputed(spark, pages, heads):
    r = random.Random(heads)
    survey = some_survey(spark)
    kept = up.keep(survey, pages, heads)
    same(kept, survey)
    ids = [(row.survey_id, row.response_id) for row in survey.responses.collect()]
    first = sorted(ids, key=lambda x: x[1])
    # The earliest ones go, most go, all of one survey go, some come back, nothing changes.
    edits = [
        [(s, i, False) for s, i in first[:40]],
        [(s, i, r.random() < 0.1) for s, i in r.sample(ids, 180)],
        [(s, i, False) for s, i in ids if s == "a"],
        [(s, i, r.random() < 0.7) for s, i in r.sample(ids, 90)],
        [],
    ]
    for rows in edits:
        decisions = spark.createDataFrame(rows, DECISIONS)
        kept = up.edit(kept, decisions)
        survey = survey.with_(responses=pin(po.apply_exclusions(survey.responses, decisions)))
        same(kept, survey, tables=rows is edits[-2])


def test_an_edit_leaves_the_earlier_state(spark):
    survey = some_survey(spark, 30, ("a",))
    before = up.keep(survey)
    up.edit(before, survey.responses.select("survey_id", "response_id", F.lit(False).alias("included")))
    same(before, survey)


def test_unknown_repeated_and_missing_decisions(spark):
    survey = some_survey(spark, 30, ("a",))
    rows = [("a", 0, True), ("a", 0, False), ("a", 1777, None), ("a", 5, False), ("zz", 0, False), ("a", 10**15, True)]
    kept = up.edit(up.keep(survey), spark.createDataFrame(rows, DECISIONS))
    same(kept, survey.with_(responses=survey.responses.withColumn("included", F.col("included") & (F.col("response_id") != 0))))


def test_empty_survey(spark):
    survey = some_survey(spark, 0, ("a",))
    survey = survey.with_(responses=spark.createDataFrame([], RESPONSES))
    kept = up.edit(up.keep(survey), spark.createDataFrame([("a", 1, False)], DECISIONS))
    assert kept.units.count() == 0 and up.kept_frequency(kept).count() == 0


def test_only_pages_of_changed_responses_are_read(spark, monkeypatch):
    survey = some_survey(spark, 60, ("a",))
    kept = up.keep(survey)
    seen, pages = [], up.Kept.pages

    def watched(self, condition):
        read = pages(self, condition)
        seen.append({row.page for row in read.select("page").distinct().collect()})
        return read

    monkeypatch.setattr(up.Kept, "pages", watched)
    last = 39 * 1777
    up.edit(kept, spark.createDataFrame([("a", last, False), ("a", last - 1777, False)], DECISIONS))
    changed = {(i >> up.BLOCK_BITS) - kept.first_block for i in (last, last - 1777)}
    assert seen[0] <= changed
