from tallyweave.operators import inference
from tallyweave.operators.inference import column_profile, infer_kinds
from tests.test_analysis import RESPONSES


def kinds(spark, columns):
    n = max(len(c) for c in columns)
    rows = [("s", i, True, [c[i] if i < len(c) else "" for c in columns]) for i in range(n)]
    got = infer_kinds(spark.createDataFrame(rows, RESPONSES)).orderBy("col_idx").collect()
    return [(r["kind"], r["chart"]) for r in got]


def test_ladder(spark):
    columns = [
        ["", "-", "N/A"],
        [f"{i * 100:,}円" for i in range(20)],
        ["5", "6", "7"] * 7,
        ["A、B", "A", "B、C", "C"] * 5,
        ["はい", "いいえ"] * 10,
        [f"選択{chr(65 + i % 8)}" for i in range(20)],
        [f"感想その{'あ' * i}です" for i in range(20)],
        [f"作業日数：{i}日\n合計作業時間：{i}時間" for i in range(1, 21)],
        [f"{'x' * i}、{'y' * i}、{'z' * i}" for i in range(1, 21)],
    ]
    assert kinds(spark, columns) == [
        ("ignore", "none"), ("numeric", "bar"), ("single", "pie"), ("multiple", "hbar"),
        ("single", "pie"), ("single", "bar"), ("free", "none"), ("multiple", "hbar"), ("free", "none"),
    ]


def test_distinct_limits_are_exact(spark):
    at_limit = [f"c{'k' * (i % 30)}" for i in range(60)]
    above = [f"c{'k' * (i % 31)}" for i in range(62)]
    many = [f"v{'q' * (i % 3000)}" for i in range(6000)]
    assert [k for k, _ in kinds(spark, [at_limit, above, many])] == ["single", "free", "free"]


def test_equal_cells_are_examined_once_and_rows_shuffled_twice(spark, monkeypatch):
    """Cells were examined one by one, and tokens shuffled before and after short cells were."""
    cells = ["Ａ、b", "a, B", "-", None, "x\uFDD0y", "\uFDD20", "長" * 70 + ";" + "\"q;r\"", '"a"', "“A”", "。"]
    rows = [(s, i, True, [cells[i % len(cells)], "k"]) for s in ("s", "t") for i in range(300)]
    df = spark.createDataFrame(rows + [("u", 1, True, None), ("u", 2, True, [])], RESPONSES)
    profile = column_profile(df)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "EvalPython" not in plan
    got = {(r["survey_id"], r["col_idx"]): r for r in profile.collect()}
    assert sorted(got) == [(s, i) for s in ("s", "t") for i in (0, 1)]
    for s in ("s", "t"):
        first = got[s, 0]
        assert (first["filled"], first["split_rows"], first["parsed"]) == (240, 90, 30)
        assert (first["distinct_values"], first["distinct_tokens"]) == (8, 7)
        assert (got[s, 1]["filled"], got[s, 1]["distinct_values"], got[s, 1]["distinct_tokens"]) == (300, 1, 1)

    seen, made = [], inference._examiner
    monkeypatch.setattr(inference, "_examiner", lambda limit: lambda text: (seen.append(text), made(limit)(text))[1])
    batch = df.select("survey_id", "cells").toArrow().combine_chunks().to_batches()[0]
    schema = [("survey_id", "string"), ("col_idx", "int32"), ("value", "binary"), ("part", "int32")]
    schema = inference.pa.schema(schema + [(name, "int64") for name in inference._FLAGS])
    assert sum(b.num_rows for b in inference._found(64, schema)(iter([batch]))) > 0
    # Long cells once for each survey, short ones once in all.
    assert len(seen) == len(set(seen)) + 1 == len(cells) + 2
