import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators.frequency import frequency
from tallyweave.operators.inference import infer_kinds
from tallyweave.operators.questions import build_questions, match_profiles, unique_names
from tallyweave.profiles import DEFAULT_PROFILES
from tallyweave.sources import delimited as dl
from tallyweave.sources.layout import column_plan, detect_layout, fold_paired, named_columns
from tests.test_analysis import RESPONSES

EXPORT_HEADER = [
    "作業ID", "作業者", "作業者ページURL", "承認日時", "1. 年齢", "", "3-1. 受注したサービス（複数選択可）", "",
    "3-2. 受注したサービス（複数選択可）", "", "3-3. 受注したサービス（複数選択可）", "", "11. 実際の作業時間", "備考", "",
]
EXPORT_ROWS = [
    ["1", "田中", "https://example.invalid/1", "2026-01-01", "4", "45～54", "1", "サービスＡ", "", "", "1", "その他、B",
     "作業日数：1日\n合計作業時間：3時間", "メモ", ""],
    ["2", "鈴木", "https://example.invalid/2", "2026-01-02", "3", "35～44", "", "", "2", "サービスA", "1", "サービスＡ", "8", "-", "迷子"],
]


def columns_of(spark, headers, sid="s"):
    return named_columns(spark.createDataFrame(
        [(sid, i, h) for i, h in enumerate(headers)], "survey_id string, col_idx int, header_raw string"))


@pytest.mark.parametrize("text,expected", [
    ("名前,年齢\n田中,30", ","), ("a\tb\n1\t2", "\t"), ("a;b;c\n1;2;3", ";"), ("a|b|c\n1|2|3", "|"),
    ("名前\t感想\n田中\tとても,よかった\n鈴木\tまあまあ,だった\n佐藤\t特に問題なし", "\t"),
    ('名前,コメント\n田中,"a\tb\tc\td"\n鈴木,"e\tf\tg\th"', ","), ("ひとつの列\nデータ", ","), ("", ","),
])
def test_sniff(text, expected):
    assert dl.sniff_delimiter(text) == expected


def test_heads_of_any_stretches_sniff_like_the_whole_text():
    random = np.random.default_rng(12)
    for _ in range(3000):
        marks = random.choice(list('ab,;\t|"\r\n\n  　'), int(random.integers(0, 90)))
        text = "".join(marks) + random.choice(["", "\n"])
        body = text[:-1] if text.endswith("\n") else text
        lines, heads, inside, at = body.split("\n"), [], False, 0
        while at < len(lines):
            part = lines[at : at + int(random.integers(1, 6))]
            both = {state: dl.Head(state) for state in (False, True)}
            for head in both.values():
                dl._feed([head], [ln.encode() for ln in part], "utf-8", any('"' in ln for ln in part))
            heads.append(both[inside].row())
            inside ^= sum(ln.count('"') for ln in part) % 2 == 1
            at += len(part)
        assert dl.sniff_heads(heads) == dl.sniff_delimiter(text), text


def write(tmp_path, name, content):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_read_files(spark, tmp_path):
    write(tmp_path, "a.csv", '名前,コメント,\r\n田中,"1行目\r\n2行目",x\r\n-,N/A,\r\n鈴木,ふつう\r\n佐藤,a,b,余分\r\n')
    write(tmp_path, "b.tsv", "\ufeff名前\t名前\t名前\nA\tB\tC")
    write(tmp_path, "c.csv", "名前,年齢\n田中,３０\n".encode("cp932"))
    write(tmp_path, "d.csv", "\n")
    write(tmp_path, "e 1.csv", "a,b")
    columns, responses, warnings = dl.read_tables(spark, str(tmp_path))
    headers = {}
    for r in columns.orderBy("survey_id", "col_idx").collect():
        headers.setdefault(r["survey_id"], []).append(r["header"])
    assert headers == {"a.csv": ["名前", "コメント", "列3"], "b.tsv": ["名前", "名前 (2)", "名前 (3)"],
                       "c.csv": ["名前", "年齢"], "e 1.csv": ["a", "b"]}
    rows = {}
    for r in responses.orderBy("survey_id", "response_id").collect():
        rows.setdefault(r["survey_id"], []).append((r["response_id"], r["cells"]))
    assert rows["a.csv"] == [(0, ["田中", "1行目\r\n2行目", "x"]), (1, ["鈴木", "ふつう", ""]), (2, ["佐藤", "a", "b"])]
    assert rows["b.tsv"] == [(0, ["A", "B", "C"])] and rows["c.csv"] == [(0, ["田中", "３０"])]
    found = {(r["survey_id"], r["code"]): r["n"] for r in warnings.collect()}
    assert found == {("a.csv", "truncated-rows"): 1, ("a.csv", "blank-rows"): 2, ("b.tsv", "renamed-headers"): 2,
                     ("c.csv", "decoded-as-cp932"): 1, ("c.csv", "blank-rows"): 1, ("d.csv", "empty-table"): 1}


BIG = "番号,本文,備考\n" + "".join(
    f'{i},"行{i}\n""引用"" {"x" * (i % 50)}\r\n終",{"余,分" if i % 10 == 0 else "y"}\n' + ("-,,\n" if i % 7 == 0 else "")
    for i in range(3000))
FILES = {
    "inch.csv": b'id,item\n1,5"monitor\n2,mouse\n3,desk\n4,pen',
    "open.csv": b'id,item\n1,a\n2,"never closed\n3,b\n4,c',
    "openlf.csv": b'id,item\n1,a\n2,"never closed\n3,b\n',
    "cp932.csv": ("番号,品目\r\n" + "".join(f"{i},表{i}｜\r\n" for i in range(400))).encode("cp932"),
    "late.csv": ("番号,品目\n" + "".join(f"{i},x{i}\n" for i in range(400)) + "9,表\n").encode("cp932"),
    "bom.tsv": "\ufeff名\t名\n\n1\t\t3\n-\tN/A".encode(),
    "crlf.csv": b'a,b\r\n"x\r\ny",2\r\n\r\n3,4\r\n',
    "cr.csv": b'a,b\r1,2\r3,4\r', "blank.csv": b",,\n1,2,3\n", "quotes.csv": b'a;b\n"x""y"z;"p;q"\n;"\n\n"\n',
    "long.csv": ("k,v\n" + "".join(f'{i},"' + "line\n" * (i * 40) + '"\n' for i in range(30))).encode(),
    # Three lines alone would give another delimiter, as would the lines of a quoted cell.
    "late;.csv": b"k;v\nk;v\nk;v\n" + b"a,b,c;;;;;\n" * 9,
    "hidden.csv": b'a|b,"' + b"x;y;z\n" * 50 + b'"\n' + b"1|2,3|\n" * 4 + b"\n  \n" + b"1,2\n" * 9,
    "big.csv": BIG.encode(), "sub/big.csv": b"other,file\n1,2\n", "sub/a+b c.csv": b"x\n1\n",
}


def plainly(content):
    """The reference reading of one file: whole text, one tokeniser."""
    import csv, io
    fallback = False
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text, fallback = content.decode("cp932", errors="replace"), True
    delimiter = dl.sniff_delimiter(text)
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    opened = dl.Quotes(delimiter).scan(text.encode(), False)[0]
    found = {"decoded-as-cp932": int(fallback), "unclosed-quote": int(opened)}
    head = rows[0] if rows else []
    if not any(h.strip() for h in head):
        return [], [], {k: n for k, n in (found | {"empty-table": 1}).items() if n}
    body = rows[1:] + ([[]] if text.endswith(("\n", "\r")) and not opened else [])
    cells = [(r + [""] * len(head))[: len(head)] for r in body]
    kept = [r for r in cells if not all(map(dl._blank, r))]
    found |= {"truncated-rows": sum(len(r) > len(head) for r in body), "blank-rows": len(cells) - len(kept)}
    return head, kept, {k: n for k, n in found.items() if n}


@pytest.mark.parametrize("split", [None, 997, 20_000])
def test_any_split_reads_like_one_text(spark, tmp_path, split):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        columns, responses, warnings = dl.read_tables(spark, str(tmp_path))
        check_tables(columns, responses, warnings, FILES)
        # One file by its own path is named by its name.
        one = dl.read_tables(spark, str(tmp_path / "sub" / "a+b c.csv"))[1].collect()
        assert [(r.survey_id, r.cells) for r in one] == [("a+b c.csv", ["1"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def check_tables(columns, responses, warnings, files):
    names, rows, found = {}, {}, {}
    for r in columns.orderBy("survey_id", "col_idx").collect():
        names.setdefault(r.survey_id, []).append(r.header_raw)
    for r in responses.orderBy("survey_id", "response_id").collect():
        assert r.response_id == len(rows.setdefault(r.survey_id, []))
        rows[r.survey_id].append(r.cells)
    for r in warnings.where("code <> 'renamed-headers'").collect():
        found.setdefault(r.survey_id, {})[r.code] = r.n
    for name, content in files.items():
        assert (names.get(name, []), rows.get(name, []), found.get(name, {})) == plainly(content), name


@pytest.mark.parametrize("lines", [1, 3, 10_000])
def test_contents_read_like_files(spark, lines, monkeypatch):
    contents = spark.createDataFrame([(n, bytearray(c)) for n, c in FILES.items() if n != "big.csv"], "survey_id string, content binary")
    if lines == 3:
        # Beyond the broadcast bound the splits' states are joined by a shuffle.
        monkeypatch.setattr(dl, "BROADCAST_SPLITS", 0)
    tables = dl.parse_lines(dl.content_lines(contents, lines))
    check_tables(*tables, {n: c for n, c in FILES.items() if n != "big.csv"})


def test_unique_names(spark):
    names = ["x", "x", "x (2)", "x", "", "", "y"]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(names)], "survey_id string, col_idx int, n string")
    got = [r["u"] for r in unique_names(df, "n", "u").orderBy("col_idx").collect()]
    assert got == ["x", "x (2)", "x (2) (2)", "x (3)", "", "", "y"]


def test_detect_and_fold(spark):
    cols = columns_of(spark, EXPORT_HEADER).unionByName(columns_of(spark, ["1. 年齢", "", "b"], "plain"))
    assert {r["survey_id"]: r["paired"] for r in detect_layout(cols).collect()} == {"s": True, "plain": False}
    plan = column_plan(cols.where("survey_id='s'")).orderBy("col_idx").collect()
    assert [(r["header"], r["forced_kind"]) for r in plan] == [
        ("作業ID", None), ("作業者", None), ("作業者ページURL", None), ("承認日時", None), ("1. 年齢", "single"),
        ("3. 受注したサービス(複数選択可)", "multiple"), ("11. 実際の作業時間", None), ("備考", None)]
    data = [("s", i, True, r) for i, r in enumerate(EXPORT_ROWS)] + [("plain", 0, True, ["1", "２", "3"])]
    columns, responses = fold_paired(cols, spark.createDataFrame(data, RESPONSES))
    got = {(r["survey_id"], r["response_id"]): r["cells"] for r in responses.collect()}
    assert got["s", 0][4:] == ["45～54", "サービスA\nその他、B", "作業日数：1日\n合計作業時間：3時間", "メモ"]
    assert got["s", 1][4:] == ["35～44", "サービスA", "8", "-"] and got["plain", 0] == ["1", "２", "3"]


MATCHES = {
    "Q12. 使用したAI・AIツールをすべて選んでください": "ai-tools", "一番使ったAIを教えてください": "main-ai",
    "AIを何に使いましたか": "ai-usage", "AI利用割合": "ai-ratio", "AIがなければこの仕事を受けましたか": "without-ai",
    "Q13. 一番よく使ったAIツールを1つ選んでください": "main-ai", "Q16. AIの出力をどれくらい修正しましたか": "human-edit",
    "Q18. クライアント側のAI利用ルールはありましたか": "client-ai-rule",
    "Q19. AIを使ったことをクライアントに伝えましたか": "disclosed-ai", "Q1. あなたの年齢を教えてください": "age",
    "Q2. 性別": "gender", "Q3. 現在の職種を教えてください": "occupation",
    "Q4. 仕事を受注したサービス・経路（複数選択可）": "channel", "Q5. 仕事を受注・開始した年": "start-year",
    "Q6. 仕事を受注・開始した月": "start-month", "Q7. 仕事の主なカテゴリ": "job-category",
    "Q8. 具体的に行った仕事内容を教えてください": "job-detail", "Q9. 契約・報酬形式": "contract-type",
    "Q10. 受け取った報酬はいくらでしたか": "reward", "Q11. 実際の作業時間": "work-hours",
    "Q20. 修正回数は何回でしたか": "revision-count", "Q21. 仕事の結果はどうなりましたか": "job-result",
    "Q22. また同じような仕事を受けたいですか": "repeat-intent", "Q23. 最後にご自由にコメントをどうぞ": "free-comment",
    "【必須】ご年齢は？": "age", "作業者": "worker-name", "作業者ページURL": "worker-url", "承認日時": "approved-at",
    "タイムスタンプ": None, "メールアドレス": None, "   ": None, "": None,
}


def test_match_profiles(spark):
    df = spark.createDataFrame([(h,) for h in MATCHES], "header string")
    got = {r["header"]: r["profile_ord"] for r in match_profiles(df).collect()}
    assert {h: o if o is None else DEFAULT_PROFILES[o].key for h, o in got.items()} == MATCHES


def test_questions_end_to_end(spark, tmp_path):
    import csv, io
    out = io.StringIO()
    csv.writer(out).writerows([EXPORT_HEADER, *EXPORT_ROWS])
    write(tmp_path, "export.csv", out.getvalue())
    write(tmp_path, "ym.csv", "回答ID,受注した年,メモ欄,受注した月,年齢,年齢\n" + "".join(
        f"R{i},{2024 + i % 2},よい,{i % 13}月,20代,30代\n" for i in range(30)))
    s = dl.read_surveys(spark, str(tmp_path))
    q = {}
    for r in s.questions.orderBy("survey_id", "q_ord").collect():
        q.setdefault(r["survey_id"], []).append((r["q_key"], r["kind"]))
    assert q["export.csv"] == [
        ("worker-id", "ignore"), ("worker-name", "ignore"), ("worker-url", "ignore"), ("approved-at", "ignore"),
        ("age", "single"), ("channel", "multiple"), ("work-hours", "single"), ("q8", "free"),
        ("work-days", "single"), ("work-minutes", "single")]
    assert [k for k, _ in q["ym.csv"]] == ["worker-id", "start-year", "q3", "start-month", "age", "age-2", "start-year-month"]
    freq = {(r["survey_id"], r["q_key"], r["label"]): r["count"] for r in frequency(s).collect()}
    assert freq["export.csv", "channel", "サービスA"] == 2 and freq["export.csv", "work-days", "1日"] == 1
    assert freq["export.csv", "work-days", "解析不能"] == 1 and freq["ym.csv", "start-year-month", "2024-02"] == 2
    assert ("export.csv", "paired-layout") in {(r["survey_id"], r["code"]) for r in s.warnings.collect()}


def test_numeric_profile_and_forced(spark):
    cols = spark.createDataFrame([("s", 0, "Q10. 報酬はいくら", None), ("s", 1, "x", "single"), ("s", 2, "年齢", "multiple")],
                                 "survey_id string, col_idx int, header string, forced_kind string")
    rows = [("s", i, True, [f"{(i + 1) * 1000 + 500}円", str(i), "a"]) for i in range(15)]
    q = build_questions(cols, infer_kinds(spark.createDataFrame(rows, RESPONSES))).orderBy("q_ord").collect()
    assert [(r["q_key"], r["kind"], r["chart"], r["unit"], r["inferred"]) for r in q] == [
        ("reward", "numeric", "bar", "円", False), ("q2", "single", "bar", None, True), ("age", "multiple", "hbar", None, False)]
    assert len(q[2]["delimiters"]) == 7 and q[0]["delimiters"] == []


def test_unique_names_of_repeated_places_and_many_batches(spark):
    rows = [("a", 0, "x"), ("a", 1, "x"), ("a", 1, "y"), ("a", None, "y"), (None, 0, "x"), ("b", 0, "x"), ("b", 0, "x")]
    df = spark.createDataFrame(rows, "survey_id string, col_idx int, n string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = sorted([("a", 0, "x", "x"), ("a", 1, "x", "x (2)"), ("a", 1, "x", "y (2)"), ("a", 1, "y", "x (2)"), ("a", 1, "y", "y (2)")]
                    + [("b", 0, "x", "x"), ("b", 0, "x", "x (2)")] * 2)
    try:
        for size in ("1", "2", "3", old):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, unique_names(df, "n", "u").collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_names_of_many_headers_are_not_broadcast(spark):
    """A header's size is underestimated from its file: a join by that estimate sent all names to the driver."""
    raw = spark.range(10).select(F.col("id").cast("string").alias("survey_id"), F.posexplode(F.array(F.lit("x"), F.lit("x"))).alias("col_idx", "header_raw"))
    plan = named_columns(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_small_files_share_batches_and_joins_are_not_broadcast(spark):
    contents = spark.createDataFrame([(str(i), bytearray(b"a;b\n1;2\n3;4\n")) for i in range(500)], "survey_id string, content binary").coalesce(1)
    lines = dl.content_lines(contents, 2)
    assert lines.count() == 1500
    # One batch of lines per file, or per split, made the reader's time.
    cut = next(iter(contents.select("survey_id", "content").toArrow().to_batches()))
    assert [b.num_rows for b in dl.cut_contents(iter([cut]), 2)] == [1500]
    files, _ = dl.profile_files(lines)
    assert files.where("delimiter = ';' AND utf8 AND ends_lf").count() == 500
    plan = dl.grown_join(lines, lines.limit(1), "survey_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_kinds_are_inferred_once_for_the_question_table(spark):
    cols = spark.createDataFrame([("s", 0, "a", None), ("s", 1, "b", None)], "survey_id string, col_idx int, header string, forced_kind string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = infer_kinds(spark.createDataFrame([("s", i, True, ["x", str(i)]) for i in range(9)], RESPONSES))
    assert build_questions(cols, made.mapInArrow(counted, made.schema)).count() == 2
    assert seen.value == 2


def test_layout_is_found_without_sorting_header_texts(spark, capsys):
    """Detection sorts marks of headers, not their texts, and naming sorts each text no more often than it must."""
    four = ["作業ID", "作業者", "作業者ページURL", "承認日時"]
    surveys = {
        "empty-next": four + ["1. a", ""], "branch": ["2-1. a"] + four, "empty-first": four + ["", "1. a"],
        "no-number": four + ["a", ""], "three": four[:3] + ["1. a", ""], "other-next": four + ["1. a", "b", ""],
        "wide": ["作業ＩＤ", *four[1:], "１．" + "長" * 5000, "　"], "repeated": four + ["1. a", "1. a", ""],
    }
    rows = [(s, 3 * i, h) for s, names in surveys.items() for i, h in enumerate(names)]
    cols = named_columns(spark.createDataFrame(rows, "survey_id string, col_idx int, header_raw string"))
    found = detect_layout(cols)
    capsys.readouterr()
    found.explain("formatted")
    text = capsys.readouterr().out
    held = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"\) Sort[^\n]*\nInput[^:]*: \[(.*)\]", text)]
    assert held == [{"survey_id", "col_idx", "header_raw", "is_empty", "_named"},
                    {"survey_id", "col_idx", "is_empty", "_managed", "_numbered", "_branched"}]
    got = {r["survey_id"]: r["paired"] for r in found.collect()}
    assert got == {s: s in ("empty-next", "branch", "wide", "repeated") for s in surveys}


def test_labels_are_folded_without_a_queue_of_rows(spark):
    """Beside a column function in Python whole rows are queued, on disk once memory is short."""
    headers = ["作業ID", "作業者", "作業者ページURL", "承認日時", "1-1. a", "", "1-2. a", "", "2-1. b", "", "3. c", ""]
    odd = ["", "-", " ＡＢ　c\r\n d ", "AB c\nd", "x\uFDD0y", "\uFDD20", "\uFDD21", "null", None, "ｶﾞ"]
    rows = [("s", i, True, ["1", "2", "3", "4", "1", a, "1", b, "1", b, "1", a]) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    other = [("t", 1000, True, ["a", None])]
    responses = spark.createDataFrame(rows + other, RESPONSES)
    cols = columns_of(spark, headers).unionByName(columns_of(spark, ["a", "b"], "t"))
    _, folded = fold_paired(cols, responses)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" in plan
    got = {r["response_id"]: r["cells"] for r in folded.collect()}
    clean = {" ＡＢ　c\r\n d ": "AB c\nd", "-": "", "null": "", None: "", "ｶﾞ": "ガ"}
    for _, i, _, cells in rows:
        a, b = (clean.get(cells[j], cells[j]) for j in (5, 7))
        both = "\n".join(dict.fromkeys(v for v in (a, b) if v))
        assert got[i] == ["1", "2", "3", "4", both, b, cells[11] or ""]
    assert got[1000] == ["a", None]
