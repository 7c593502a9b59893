import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.constants import SAFE_DELIMITERS
from tallyweave.model import question
from tallyweave.operators import crosstab as ct, policy as po, questions as qs
from tallyweave.operators.frequency import frequency, frequency_totals, survey_counters
from tallyweave.plans.survey import analysis_documents, analyze
from tallyweave.sinks import reports as rp
from tests.test_analysis import survey_of
from tests.test_crosstab import pairs

HEADERS = ["性別", "使用したAI", "コメント", "年収", "作業者", "承認日時", "空"]
QUESTIONS = [
    question("s", 0, "gender", "single", label="性別"),
    question("s", 1, "ai", "multiple", label="使用したAI"),
    question("s", 2, "free", "free", label="コメント"),
    question("s", 3, "pay", "numeric", label="年収", unit="円"),
    question("s", 4, "worker-name", "ignore", label="作業者名", identity="worker-name"),
    question("s", 5, "approved-at", "ignore", label="承認日時", identity="approved-at"),
    question("s", 6, "none", "single", label="空|欄"),
]
ROWS = [
    ["女性", "ChatGPT、Claude", "よい\n便利", "1,000円", "田中", "1/1", ""],
    ["女性", "ChatGPT", "-", "2000円", "鈴木", "1/2", ""],
    ["男性", "chatgpt", "", "不明", "佐藤", "1/3", "-"],
    ["女性", "ChatGPT", "秘密,本文", "3000円", "高橋", "1/4", "N/A"],
    ["男性", "Claude", "除外される", "9999円", "伊藤", "1/5", "x"],
]


@pytest.fixture(scope="module")
def survey(spark):
    s = survey_of(spark, QUESTIONS, ROWS, excluded={4})
    cols = spark.createDataFrame([("s", i, h) for i, h in enumerate(HEADERS)], "survey_id string, col_idx int, header string")
    return s.with_(columns=cols)


def text(lines):
    keys = [k for k in (*ct.PAIR, *rp.ORDER[1:]) if k in lines.columns]
    return [r["line"] for r in lines.orderBy(*keys).collect()]


def test_summary_csv_and_markdown(spark, survey):
    a = analyze(survey)
    assert text(rp.summary_csv(a)) == [
        "question,option,count,percentage,valid_responses,multiple_choice",
        "性別,女性,3,75.00,4,false", "性別,男性,1,25.00,4,false",
        "使用したAI,ChatGPT,4,100.00,4,true", "使用したAI,Claude,1,25.00,4,true",
        "コメント,(自由記述),2,100.00,2,false",
        '年収,"1,000円",1,25.00,4,false', '年収,"2,000円",1,25.00,4,false', '年収,"3,000円",1,25.00,4,false',
        "空|欄,(回答なし),0,0.00,0,false",
    ]
    md = "\n".join(text(rp.summary_markdown(a, "gen")))
    assert md.startswith("# 生成AI仕事利用アンケート 集計結果\n\n- データ名: s\n- 生成日時: ")
    assert "\n- 出力元: gen\n- 全回答数: 5件\n- 有効回答数(集計対象): 4件\n- 除外回答数: 1件\n\n## 性別\n" in md
    assert "\n## 使用したAI\n\n※複数回答（合計が100%を超えることがあります）\n\n有効回答数: 4件（未回答 0件 / 集計対象 4件）\n\n| 選択肢 | 人数 | 割合 |\n|---|---:|---:|\n| ChatGPT | 4 | 100.0% |\n| Claude | 1 | 25.0% |\n\n## コメント\n" in md
    assert "回答件数: 2件（本文は個人情報配慮のため出力しません）" in md and "秘密" not in md and "田中" not in md
    assert "- 件数: 3件（うち数値として読み取れなかった回答 1件）\n- 平均: 2,000.0円\n- 中央値: 2,000.0円\n- 最小: 1,000円\n- 最大: 3,000円\n- 第1四分位: 1,000円\n- 第3四分位: 3,000円\n\n| 選択肢" in md
    assert "## 空|欄\n\n有効回答数: 0件（未回答 4件 / 集計対象 4件）\n\n（集計対象となる回答がありません）\n\n---\n" in md


def test_analysis_json(spark, survey, tmp_path):
    docs = analysis_documents(analyze(survey), generator="g")
    rp.write_json(docs, str(tmp_path / "j"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "j").glob("*/part-*"))))
    assert (doc["totalResponses"], doc["includedResponses"], doc["excludedResponses"]) == (5, 4, 1)
    assert [q["key"] for q in doc["questions"]] == ["gender", "ai", "free", "pay", "none"]
    ai, free, pay = doc["questions"][1:4]
    assert ai["items"][0] == {"label": "ChatGPT", "count": 4, "percentage": 100.0} and ai["totalSelections"] == 5
    assert free["freeTextSamples"] == ["よい\n便利", "秘密,本文"] and "freeTextSamples" not in ai
    assert pay["numeric"]["unparsed"] == 1 and pay["numeric"]["unit"] == "円"


def test_selection_policy(spark, survey):
    picked = spark.createDataFrame([("s", "ai", False), ("s", "free", False), ("s", "worker-name", True)],
                                   "survey_id string, q_key string, selected boolean")
    s = survey.with_(questions=qs.select_questions(survey.questions, picked))
    keys = {r["q_key"] for r in analyze(s).items.collect()}
    assert keys == {"gender", "pay"}
    assert ct.crosstab(s, pairs(spark, ("gender", "ai"))).count() > 0
    assert any("秘密" in l for l in text(rp.free_text_markdown(s, survey_counters(s.responses))))
    assert qs.select_all(survey.questions, False).where("selected").count() == 2
    assert set(po.POLICY) >= {"frequency", "audit_csv", "crosstab"}


def test_free_text_markdown(spark, survey):
    lines = text(rp.free_text_markdown(survey, survey_counters(survey.responses)))
    assert lines == ["# 自由記述回答", "", "集計対象回答数: 4件", "自由記述あり: 2件", "対象の設問: コメント", "",
                     "## 回答 1", "", "よい\n便利", "", "## 回答 4", "", "秘密,本文", ""]
    two = survey_of(spark, [question("s", 0, "a", "free"), question("s", 1, "b", "free")], [["x", "y"], ["", ""]])
    assert "**b**" in text(rp.free_text_markdown(two, survey_counters(two.responses)))
    none = survey_of(spark, [question("s", 0, "a", "single")], [["x"]])
    assert text(rp.free_text_markdown(none, survey_counters(none.responses)))[-2:] == ["（自由記述として扱っている設問がありません）", ""]


def test_crosstab_reports(spark):
    q = [question("s", 0, "ai", "multiple", label="使用したAI"), question("s", 1, "age", "single", label="年齢", order="natural")]
    s = survey_of(spark, q, [["ChatGPT、Claude", "20代"], ["ChatGPT", "20代"], ["ChatGPT、Claude", "30代"], ["Claude", "30代"], ["ChatGPT", "30代"]])
    p = pairs(spark, ("ai", "age"))
    tidy = ct.crosstab(s, p)
    assert text(rp.crosstab_csv(s, tidy, p)) == [
        "# 行: 使用したAI / 列: 年齢 / 有効回答者数: 5 / 表示: count", "使用したAI,20代,30代,合計(実人数)",
        "ChatGPT,2,2,4", "Claude,1,2,3", "合計(実人数),2,3,5"]
    assert text(rp.crosstab_markdown(s, tidy, p, "row")) == [
        "## クロス集計: 使用したAI × 年齢", "", "対象者数（行・列の両方に有効回答）: 5件",
        "表示: 実数（行%）… 割合の分母は各行の該当者数", "", rp.ROW_NOTE, "",
        "| 使用したAI | 20代 | 30代 | 合計(実人数) |", "|---|---:|---:|---:|",
        "| ChatGPT | 2 (50.0%) | 2 (50.0%) | 4 |", "| Claude | 1 (33.3%) | 2 (66.7%) | 3 |",
        "| 合計(実人数) | 2 | 3 | 5 |", ""]
    bad = pairs(spark, ("ai", "zz"))
    assert text(rp.crosstab_csv(s, ct.crosstab(s, bad), bad)) == [
        "# 行: 使用したAI / 列:  / 有効回答者数: 0 / 表示: count", "使用したAI,合計(実人数)", "合計(実人数),0"]


def test_audit_csv_and_bom(spark, survey, tmp_path):
    hidden = po.hidden_columns(survey.questions)
    lines = text(rp.audit_csv(survey, hidden))
    assert lines[0] == "No,性別,使用したAI,コメント,年収,承認日時,空,included"
    assert lines[1] == '1,女性,ChatGPT、Claude,"よい\n便利","1,000円",1/1,,true' and lines[5].endswith("1/5,x,false")
    assert "田中" in text(rp.audit_csv(survey))[1]
    rp.write_lines(rp.audit_csv(survey, hidden), str(tmp_path / "a"), bom=True, line_sep="\r\n")
    body = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "a").glob("part-*"))).decode()
    assert body.startswith("﻿No,性別") and body.count("﻿") == 1 and body.split("\r\n")[5].startswith("5,男性")


def test_rows_and_identity(spark, survey):
    r = survey.responses
    assert po.search(r, " CHATGPT ").count() == 4 and po.search(r, "田中").count() == 1
    hidden = po.hidden_columns(survey.questions)
    assert hidden.first()["hidden"] == [4] and po.search(r, "田中", hidden).count() == 0
    none = po.hidden_columns(survey.questions, ("worker-name", "approved-at")).first()
    assert none["hidden"] == []
    c = po.response_counters(r, "女性").first()
    assert (c["total"], c["matched"], c["included"], c["excluded"]) == (5, 3, 4, 1)
    off = po.set_included(r, False, "claude")
    assert [x["included"] for x in off.orderBy("response_id").collect()] == [False, True, True, True, False]
    overlay = spark.createDataFrame([("s", 4, True), ("s", 0, False)], "survey_id string, response_id bigint, included boolean")
    assert [x["included"] for x in po.apply_exclusions(r, overlay).orderBy("response_id").collect()] == [False, True, True, True, True]
    page = po.listing_page(r, hidden, "女性").orderBy("no").collect()
    assert [x["no"] for x in page] == [1, 2, 4] and len(page[0]["cells"]) == 6
    assert [x["identity"] for x in po.identity_questions(survey.questions).orderBy("position").collect()] == ["worker-name", "approved-at"]
    long = spark.range(1).select(po.shortened(F.repeat(F.lit("あ"), 41)).alias("x"), po.shortened(F.repeat(F.lit("あ"), 40)).alias("y")).first()
    assert long["x"] == "あ" * 40 + "…" and long["y"] == "あ" * 40


def test_overrides(spark, survey):
    wish = spark.createDataFrame([("s", "gender", "multiple", None), ("s", "worker-name", "free", "bar"), ("s", "pay", None, "pie"), ("s", "ai", "free", None)],
                                 "survey_id string, q_key string, kind string, chart string")
    got = {r["q_key"]: (r["kind"], r["chart"], len(r["delimiters"])) for r in qs.override_questions(survey.questions, wish).collect()}
    assert got["gender"] == ("multiple", "hbar", len(SAFE_DELIMITERS)) and got["worker-name"] == ("ignore", "none", 0)
    assert got["pay"] == ("numeric", "pie", 0) and got["ai"] == ("free", "none", 0)


def test_column_report_and_charts(spark, survey):
    freq = frequency(survey)
    totals = frequency_totals(freq)
    report = {r["q_key"]: (r["origin"], r["options"]) for r in qs.column_report(survey.questions, totals).collect()}
    assert report["gender"] == (None, 2) and report["free"][1] is None and report["none"][1] == 0
    assert {r["q_key"] for r in qs.chart_series(freq, survey.questions).collect()} == {"gender", "ai"}
    t = {r["q_key"]: (r["count_sum"], r["percentage_sum"]) for r in totals.collect()}
    assert t["ai"] == (5, 125.0)
