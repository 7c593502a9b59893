"""Cross-tabs by bitmaps against those by pairs of cells and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.model import define_survey, question
from tallyweave.operators import bitmaps as bm, crosstab as ct
from tests.test_analysis import RESPONSES

KEYS = ("sex", "tools", "age", "place", "note")


def some_survey(spark, n=500, empty=False):
    r = random.Random(4)
    rows = []
    for i in range(0 if empty else n):
        tools = "、".join(r.sample(["ChatGPT", "ＣｈａｔＧＰＴ", "Claude", "Gemini", "その他"], r.randint(0, 3)))
        cells = [r.choice(["女性", "男性", "", "-"]), tools, str(r.randint(15, 80)), r.choice("abcdefgh") + r.choice(["", " ", "。"]), f"t{r.randint(0, 300)}"]
        # Ids on both sides of zero and in several blocks.
        rows.append(("s", (i - 100) * 997, r.random() < 0.9, cells))
    kinds = ("single", "multiple", "numeric", "single", "single")
    questions = [question("s", i, k, kind, order="natural") for i, (k, kind) in enumerate(zip(KEYS, kinds))]
    return define_survey(spark, spark.createDataFrame(rows, RESPONSES), questions)


def collected(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("most", [bm.MOST_OPTIONS, 6])
def test_as_pairs_of_cells(spark, most):
    survey = some_survey(spark)
    pairs = ct.all_pairs(survey)
    assert len(pairs) == 10
    got = collected(bm.crosstab_of_many(survey, pairs, most))
    assert got and got == collected(ct.crosstab(survey, pairs))


def test_rows_do_not_grow_with_pairs(spark):
    survey = some_survey(spark)
    cells = bm.answer_cells(survey, ct.eligible(survey.questions))
    index = bm.option_index(survey, cells, bm._question_options(survey, cells))
    blocks = index.select("block").distinct().count()
    options = index.select("q_key", "opt", "label").distinct().count()
    assert index.count() <= blocks * options
    answered = {r.q_key: r.n for r in index.where("opt IS NULL").groupBy("q_key").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()}
    included = survey.responses.where("included")
    assert answered["age"] == included.count()
    assert answered["sex"] == included.where("cells[0] IN ('女性', '男性')").count()


def test_first_common_response_and_counts():
    import pyarrow as pa

    one, two = bytearray(4096), bytearray(4096)
    for k in (5, 9, 30_000):
        one[k // 8] |= 1 << k % 8
    for k in (9, 12, 30_000):
        two[k // 8] |= 1 << k % 8
    none = bytes(4096)
    rows = {k: ["x"] * 2 for k in bm._KEYS} | {"block": [-1, 3], "row_bits": [bytes(one), bytes(one)], "col_bits": [bytes(two), none]}
    (out,) = bm._common(iter([pa.RecordBatch.from_pydict(rows)]))
    assert out.num_rows == 1 and out.column("n").to_pylist() == [2]
    assert out.column("first_id").to_pylist() == [-(1 << 15) + 9]


def test_no_responses(spark):
    survey = some_survey(spark, empty=True)
    assert bm.crosstab_of_many(survey, ct.all_pairs(survey)).count() == 0
