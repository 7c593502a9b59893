"""Frequency, numeric and cross-tab goldens on tiny hand-built surveys."""

from pyspark.sql import functions as F

from tallyweave.model import define_survey, question
from tallyweave.operators import frequency as fr, numeric as nu
from tallyweave.operators.ranking import ranked
from tallyweave.operators.units import interpreted_units
from tallyweave.session import pin

RESPONSES = "survey_id string, response_id bigint, included boolean, cells array<string>"


def survey_of(spark, questions, rows, excluded=(), sid="s"):
    data = [(sid, i, i not in excluded, list(r)) for i, r in enumerate(rows)]
    return define_survey(spark, spark.createDataFrame(data, RESPONSES), questions)


def freq_rows(survey):
    rows = fr.frequency(survey).orderBy("q_key", "rank").collect()
    return [(r["q_key"], r["label"], r["count"], r["percentage"]) for r in rows]


def test_single_frequency_and_blanks(spark):
    values = ["女性"] * 5 + ["男性"] * 3 + ["", "-", "N/A"]
    s = survey_of(spark, [question("s", 0, "g", "single")], [[v] for v in values])
    assert freq_rows(s) == [("g", "女性", 5, 62.5), ("g", "男性", 3, 37.5)]
    stats = fr.question_stats(interpreted_units(s)).first()
    assert (stats.valid, stats.blank, stats.total_selections) == (8, 3, 8)


def test_exclusion_rounding_and_first_spelling(spark):
    rows = [["ＡＩ。"], ["ai"], ["B"], ["x"]]
    s = survey_of(spark, [question("s", 0, "q", "single")], rows, excluded={3})
    assert freq_rows(s) == [("q", "AI。", 2, 66.67), ("q", "B", 1, 33.33)]


def test_multiple_choice_dedup_and_alias(spark):
    aliases = {"chatgpt": "ChatGPT", "chat gpt": "ChatGPT", "クロード": "Claude"}
    rows = [["ChatGPT、chat gpt、Claude"], ["クロード\nＣＨＡＴＧＰＴ"], ["Gemini,Gemini"], ["、"]]
    s = survey_of(spark, [question("s", 0, "ai", "multiple", aliases=aliases)], rows)
    assert freq_rows(s) == [
        ("ai", "ChatGPT", 2, 66.67), ("ai", "Claude", 2, 66.67), ("ai", "Gemini", 1, 33.33)]
    stats = fr.question_stats(interpreted_units(s)).first()
    assert (stats.valid, stats.blank, stats.total_selections) == (3, 1, 5)


def test_option_orders(spark):
    values = ["30代"] * 2 + ["10代"] * 2 + ["その他"] * 3 + ["不明"] * 3
    rows = [[v, v, v] for v in values]
    qs = [question("s", 0, "p", "single", order="preset", presets=["10代", "20代", "30代", "10代"]),
          question("s", 1, "c", "single", order="count"),
          question("s", 2, "n", "single", order="natural")]
    got = freq_rows(survey_of(spark, qs, rows))
    labels = {k: [l for q, l, _, _ in got if q == k] for k in "pcn"}
    assert labels["p"][:2] == ["10代", "30代"] and set(labels["p"][2:]) == {"その他", "不明"}
    assert labels["c"][2:] == ["10代", "30代"] and labels["c"][:2] == labels["p"][2:]
    assert labels["n"][:2] == ["10代", "30代"]


def test_ranked_range_path_equals_window_path(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"),
        F.xxhash64("id").alias("v"), "id")
    order = [F.col("v").desc()]
    a = ranked(df, ["g"], order)
    b = ranked(df, ["g"], order, max_group=10, partitions=7)
    assert sorted(a.collect()) == sorted(b.select(a.columns).collect())


def numeric_survey(spark, values, unit=None):
    return survey_of(spark, [question("s", 0, "n", "numeric", unit=unit)], [[v] for v in values])


def test_numeric_with_unparsed(spark):
    s = numeric_survey(spark, ["1,000円", "2000", "3千円", "不明", ""], "円")
    units = pin(interpreted_units(s))
    summary = nu.numeric_summary(units).first()
    assert (summary["n"], summary["unparsed"], summary["sum"], summary["median"]) == (3, 1, 6000, 2000)
    stats = fr.question_stats(units)
    hist = nu.histogram(nu.value_counts(units), s.questions.select("survey_id", "q_key", "unit"),
                        stats.select("survey_id", "q_key", "valid")).orderBy("rank").collect()
    assert [(r["label"], r["count"], r["percentage"]) for r in hist] == [
        ("1,000円", 1, 25.0), ("2,000円", 1, 25.0), ("3,000円", 1, 25.0)]


def test_quartiles(spark):
    units = interpreted_units(numeric_survey(spark, [str(v) for v in range(10, 90, 10)]))
    r = nu.numeric_summary(units).first()
    assert (r["p25"], r["p75"], r["median"], r["min"], r["max"], r["mean"]) == (30, 70, 45, 10, 80, 45)


def test_quartiles_against_brute_force(spark):
    import random
    rnd = random.Random(3)
    vals = [rnd.choice([-1, 1]) * round(rnd.lognormvariate(3, 4), rnd.randint(0, 5)) for _ in range(997)] + [0.0] * 20
    df = spark.createDataFrame([("s", "q", float(v)) for v in vals], "survey_id string, q_key string, value double")
    r = nu.order_statistics(df.groupBy("survey_id", "q_key", "value").agg(F.count("*").alias("c"))).first()
    xs = sorted(vals)
    n = len(xs)
    assert (r["p25"], r["p75"]) == (xs[int(n * 0.25)], xs[int(n * 0.75)])
    assert r["median"] == (xs[n // 2] if n % 2 else float("%.11e" % ((xs[n // 2 - 1] + xs[n // 2]) / 2)))


def histogram_of(spark, values, unit=None):
    s = numeric_survey(spark, [repr(v) for v in values], unit)
    units = pin(interpreted_units(s))
    return nu.histogram(nu.value_counts(units), s.questions.select("survey_id", "q_key", "unit"),
                        fr.question_stats(units).select("survey_id", "q_key", "valid")
                        ).orderBy("rank").collect()


def test_nice_width_histogram(spark):
    bins = histogram_of(spark, list(range(0, 20001, 1000)), "円")
    assert len(bins) == 10 and (bins[0]["bin_from"], bins[0]["bin_to"]) == (0, 2000)
    assert [bins[0]["label"], bins[1]["label"], bins[-1]["label"]] == [
        "0〜1,999円", "2,000〜3,999円", "18,000〜20,000円"]
    assert bins[-1]["count"] == 3 and sum(b["count"] for b in bins) == 21
    assert all(a["bin_to"] == b["bin_from"] for a, b in zip(bins, bins[1:]))


def test_histogram_keeps_empty_bins_and_decimals(spark):
    bins = histogram_of(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 100])
    assert [b["count"] for b in bins if b["count"] == 0] and sum(b["count"] for b in bins) == 12
    small = histogram_of(spark, [i / 100 for i in range(30)])
    assert [b["label"] for b in small[:2]] == ["0.00〜0.01", "0.02〜0.03"] or len(small) <= 12
    assert sum(b["count"] for b in small) == 30
    ten = histogram_of(spark, list(range(1, 11)), "回")
    assert [b["label"] for b in ten] == [f"{i}回" for i in range(1, 11)]


def test_free_and_derived(spark):
    qs = [question("s", 0, "y", "single", order="natural"), question("s", 1, "m", "single"),
          question("s", 2, "t", "free"), question("s", 3, "w", "free"),
          question("s", 4, "ym", "single", order="natural", derived=("year-month", 0, 1, None)),
          question("s", 5, "d", "single", order="preset", presets=["1日", "2日", "解析不能"],
                   derived=("work-days", None, None, 3)),
          question("s", 6, "h", "single", derived=("work-minutes", None, None, 3))]
    rows = [["2024", "1月", "x" * 300, "作業日数：1日\n合計作業時間：3時間"],
            ["24", "11", "-", "作業日数：半日\n合計作業時間：45分"],
            ["2024年", "13月", "  ", ""]]
    s = survey_of(spark, qs, rows)
    got = [r for r in freq_rows(s) if r[0] in ("ym", "d", "h")]
    assert got == [("d", "1日", 1, 50.0), ("d", "解析不能", 1, 50.0),
                   ("h", "3~5時間未満", 1, 50.0), ("h", "30分~1時間未満", 1, 50.0),
                   ("ym", "2024-01", 1, 50.0), ("ym", "2024-11", 1, 50.0)]
    stats = {r["q_key"]: (r["valid"], r["blank"]) for r in fr.question_stats(interpreted_units(s)).collect()}
    assert stats["t"] == (1, 2) and stats["w"] == (2, 1)


def test_fractional_year_is_kept_and_warned(spark):
    from tallyweave.operators.units import fractional_year_warnings

    q = [question("s", 0, "ym", "single", derived=("year-month", 0, 1, None))]
    s = survey_of(spark, q, [["2023-2024", "1"], ["2024", "2"], ["2023〜2024", "1月"]])
    units = interpreted_units(s)
    assert [(l, n) for _, l, n, _ in freq_rows(s)] == [("2023.5-01", 2), ("2024-02", 1)]
    found = fractional_year_warnings(units, s.questions).collect()
    assert [(r["survey_id"], r["code"], r["n"]) for r in found] == [("s", "fractional-year", 2)]
