"""From column headers and inferred kinds to the question table.

Headers and questions are metadata, one row per column of a survey. Nothing here reads
responses except through the inferred kinds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyweave.constants import DAYS_PRESET, KINDS_CHART, MINUTES_PRESET, SAFE_DELIMITERS
from tallyweave.functions.text import let, norm_header
from tallyweave.profiles import DEFAULT_PROFILES, Profile
from tallyweave.session import pin

_NAMES = (
    "survey_id", "q_ord", "q_key", "col_idx", "header", "label", "kind", "chart", "delimiters",
    "opt_order", "preset_options", "option_aliases", "unit", "selected", "identity", "inferred",
    "profile_key", "derived",
)


# ---- ordered de-duplication of names ------------------------------------------------------


class _Names:
    """Names of one header made unique in order: a repeat takes the first free `name + suffix`.

    `suffix` holds `{n}`, counted from `first`; empty names stay empty. Numbers of a name only
    grow, so each name is looked up about once.
    """

    def __init__(self, first: int, suffix: str):
        self._first, self._suffix, self._taken, self._following = first, suffix, set(), {}

    def unique(self, name: str | None) -> str | None:
        chosen = name
        if name and name in self._taken:
            n = self._following.get(name, self._first)
            while (chosen := name + self._suffix.format(n=n)) in self._taken:
                n += 1
            self._following[name] = n + 1
        self._taken.add(chosen)
        return chosen


def _with_names(batch: pa.RecordBatch, names: list, places: list[tuple], into: str) -> pa.RecordBatch:
    """Rows with their names; rows of one place get each of its names, rows without one go."""
    if len(set(places)) < len(places) or any(p[1] is None for p in places):
        runs = (list(run) for place, run in groupby(range(len(places)), places.__getitem__) if place[1] is not None)
        pairs = [(i, names[j]) for run in runs for i in run for j in run]
        batch, names = batch.take(pa.array([i for i, _ in pairs], pa.int64())), [name for _, name in pairs]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], [*batch.schema.names, into])


def unique_names(
    columns: DataFrame, source: str, into: str, first: int = 2, suffix: str = " ({n})", by: str = "col_idx"
) -> DataFrame:
    """Add a unique version of `source` within each survey, in column order.

    Rows are sorted by survey and named as they pass: no header is collected and nothing joined.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey, header, held, held_names = None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = held_names
            for sid, name in zip(batch.column("survey_id").to_pylist(), batch.column(source).to_pylist()):
                if sid != survey:
                    survey, header = sid, _Names(first, suffix)
                names.append(header.unique(name))
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            places = list(zip(batch.column("survey_id").to_pylist(), batch.column(by).to_pylist()))
            # The last place may go on in the next batch.
            end = len(places) - 1
            while end and places[end - 1] == places[-1]:
                end -= 1
            if end:
                yield _with_names(batch.slice(0, end), names[:end], places[:end], into)
            held, held_names, held_places = batch.slice(end), names[end:], places[end:]
        if held is not None:
            yield _with_names(held, held_names, held_places, into)

    kept = ["survey_id", by, *(c for c in columns.columns if c not in ("survey_id", by))]
    placed = columns.select(kept).where("survey_id IS NOT NULL")
    fields = [T.StructField(f.name, f.dataType) for f in placed.schema.fields]
    ordered = placed.repartition("survey_id").sortWithinPartitions("survey_id", by, source)
    return ordered.mapInArrow(named, T.StructType([*fields, T.StructField(into, T.StringType())]))


# ---- profile matching ---------------------------------------------------------------------


def _profile_struct(p: Profile, ordinal: int) -> Column:
    text = lambda v: F.lit(v).cast("string")
    texts = lambda vs: F.array(*[F.lit(v) for v in vs]) if vs else F.lit(None).cast("array<string>")
    pairs = [F.lit(x) for kv in p.aliases.items() for x in kv]
    return F.struct(
        F.lit(ordinal).alias("ord"),
        text(p.key).alias("key"),
        text(p.label).alias("label"),
        text(p.kind).alias("kind"),
        text(p.chart).alias("chart"),
        text(p.order).alias("order"),
        text(p.unit).alias("unit"),
        text(p.identity).alias("identity"),
        texts(p.delimiters).alias("delimiters"),
        texts(p.presets).alias("presets"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("aliases"),
    )


def match_profiles(
    columns: DataFrame, profiles: Sequence[Profile] = DEFAULT_PROFILES, header: str = "header"
) -> DataFrame:
    """Add `profile_ord`: exact header match first, then the longest contained pattern, then
    definition order; NULL without a match.

    The pattern dictionary is a constant of bounded size, so each header tests it in place
    and no join is needed.
    """
    patterns = F.array(
        *[
            F.struct(F.lit(text).alias("text"), F.lit(i).alias("ord"))
            for text, i in _pattern_keys(columns.sparkSession, profiles)
        ]
    )

    def best(h: Column) -> Column:
        hits = F.filter(patterns, lambda p: h.contains(p["text"]))
        scored = F.transform(
            hits,
            lambda p: F.struct(
                (p["text"] == h).alias("exact"), F.length(p["text"]).alias("length"), (-p["ord"]).alias("earlier")
            ),
        )
        # Among exact matches the definition order decides, as their lengths are equal.
        return -F.array_max(scored)["earlier"]

    keyed = columns.withColumn("_header_key", norm_header(F.col(header)))
    found = F.when(F.col("_header_key") != "", let(F.col("_header_key"), best))
    return keyed.withColumn("profile_ord", found).drop("_header_key")


def _pattern_keys(spark, profiles: Sequence[Profile]) -> list[tuple[str, int]]:
    """Header keys of all labels and patterns; the dictionary is a few hundred short texts."""
    rows = [(t, i) for i, p in enumerate(profiles) for t in (p.label, *p.patterns)]
    df = spark.createDataFrame(rows, "t string, i int")
    keyed = df.select(norm_header(F.col("t")).alias("t"), "i").where("t <> ''").distinct()
    return sorted(((r.t, r.i) for r in keyed.collect()), key=lambda r: (r[1], r[0]))


# ---- question table -----------------------------------------------------------------------


def chart_for(kind: Column, fallback: Column) -> Column:
    """Chart of a kind fixed by the layout; single choice keeps the suggested chart."""
    fixed = F.when(kind == "multiple", "hbar").when(kind == "numeric", "bar")
    single = F.when(fallback == "none", "bar").otherwise(fallback)
    return fixed.when(kind == "single", single).otherwise("none")


def resolve_kind(profile_kind: Column, inferred: Column) -> Column:
    """A profile's kind stands, except that single choice full of numbers becomes numeric."""
    return F.when((profile_kind == "single") & (inferred == "numeric"), inferred).otherwise(profile_kind)


def build_questions(
    columns: DataFrame,
    inferred: DataFrame,
    profiles: Sequence[Profile] = DEFAULT_PROFILES,
) -> DataFrame:
    """Question table from columns(survey_id, col_idx, header, forced_kind) and inferred
    kinds(survey_id, col_idx, kind, chart); derived questions come last."""
    catalogue = F.array(*[_profile_struct(p, i) for i, p in enumerate(profiles)])
    # Inferring reads all responses and the table below uses its few rows twice: kept, it runs once.
    found = pin(inferred.select(
        "survey_id", "col_idx", F.col("kind").alias("_kind"), F.col("chart").alias("_chart")
    ))
    df = (
        match_profiles(columns, profiles)
        .join(found, ["survey_id", "col_idx"], "left")
        .withColumn("_kind", F.coalesce("_kind", F.lit("ignore")))
        .withColumn("_chart", F.coalesce("_chart", F.lit("none")))
        .withColumn("p", F.get(catalogue, F.col("profile_ord")))
    )
    p, forced = F.col("p"), F.col("forced_kind")
    known = p.isNotNull()
    df = df.withColumn(
        "kind",
        F.coalesce(forced, F.when(known, resolve_kind(p["kind"], F.col("_kind"))), F.col("_kind")),
    )
    kind = F.col("kind")
    profile_chart = (
        F.when(forced.isNotNull() & (forced != p["kind"]), chart_for(forced, p["chart"]))
        .when((kind == "numeric") & (p["kind"] != "numeric"), "bar")
        .otherwise(p["chart"])
    )
    plain_chart = F.when(forced.isNotNull(), chart_for(forced, F.col("_chart"))).otherwise(
        F.col("_chart")
    )
    safe = F.array(*[F.lit(d) for d in SAFE_DELIMITERS])
    none = F.array().cast("array<string>")
    df = df.select(
        "survey_id",
        F.col("col_idx").alias("q_ord"),
        F.coalesce(p["key"], F.concat(F.lit("q"), (F.col("col_idx") + 1).cast("string"))).alias("_base"),
        "col_idx",
        "header",
        F.coalesce(p["label"], "header").alias("label"),
        "kind",
        F.when(known, profile_chart).otherwise(plain_chart).alias("chart"),
        F.when(kind == "multiple", F.coalesce(p["delimiters"], safe)).otherwise(none).alias("delimiters"),
        F.coalesce(p["order"], F.lit("count")).alias("opt_order"),
        p["presets"].alias("preset_options"),
        p["aliases"].alias("option_aliases"),
        p["unit"].alias("unit"),
        F.lit(True).alias("selected"),
        p["identity"].alias("identity"),
        (~known).alias("inferred"),
        p["key"].alias("profile_key"),
        F.lit(None).cast("struct<type:string,year_col:int,month_col:int,source_col:int>").alias("derived"),
    )
    everything = df.unionByName(derived_questions(df))
    return unique_names(everything, "_base", "q_key", suffix="-{n}", by="q_ord").select(*_NAMES)


def derived_questions(base: DataFrame) -> DataFrame:
    """Year-month and work-time questions for surveys whose source columns were recognised."""
    at = lambda key: F.min(F.when(F.col("profile_key") == key, F.col("col_idx")))
    sources = base.groupBy("survey_id").agg(
        (F.max("q_ord") + 1).alias("next"),
        at("start-year").alias("year"),
        at("start-month").alias("month"),
        at("work-hours").alias("hours"),
    )
    text = lambda v: F.lit(v).cast("string")
    presets = lambda vs: F.array(*[F.lit(v) for v in vs]) if vs else F.lit(None).cast("array<string>")

    def spec(key, header, label, chart, order, options, kind, present, year, month, source):
        made = F.struct(
            text(key).alias("key"), text(header).alias("header"), text(label).alias("label"),
            text(chart).alias("chart"), text(order).alias("order"), presets(options).alias("presets"),
            F.struct(
                text(kind).alias("type"), year.cast("int").alias("year_col"),
                month.cast("int").alias("month_col"), source.cast("int").alias("source_col"),
            ).alias("derived"),
        )
        return F.when(present, made)

    none, hours = F.lit(None), F.col("hours")
    specs = F.array_compact(
        F.array(
            spec("start-year-month", "(派生) 年 + 月", "仕事を受注・開始した年月", "line", "natural", (),
                 "year-month", F.col("year").isNotNull() & F.col("month").isNotNull(),
                 F.col("year"), F.col("month"), none),
            spec("work-days", "(派生) 実際の作業時間 → 作業日数", "作業日数（派生）", "bar", "preset",
                 DAYS_PRESET, "work-days", hours.isNotNull(), none, none, hours),
            spec("work-minutes", "(派生) 実際の作業時間 → 合計作業時間", "合計作業時間（派生）", "bar", "preset",
                 MINUTES_PRESET, "work-minutes", hours.isNotNull(), none, none, hours),
        )
    )
    rows = sources.select("survey_id", "next", F.posexplode(specs).alias("pos", "s"))
    s = F.col("s")
    return rows.select(
        "survey_id",
        (F.col("next") + F.col("pos")).alias("q_ord"),
        s["key"].alias("_base"),
        F.lit(-1).alias("col_idx"),
        s["header"].alias("header"),
        s["label"].alias("label"),
        F.lit("single").alias("kind"),
        s["chart"].alias("chart"),
        F.array().cast("array<string>").alias("delimiters"),
        s["order"].alias("opt_order"),
        s["presets"].alias("preset_options"),
        F.lit(None).cast("map<string,string>").alias("option_aliases"),
        F.lit(None).cast("string").alias("unit"),
        F.lit(True).alias("selected"),
        F.lit(None).cast("string").alias("identity"),
        F.lit(False).alias("inferred"),
        s["key"].alias("profile_key"),
        s["derived"].alias("derived"),
    )


def override_questions(questions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply overrides(survey_id, q_key, kind, chart); NULL keeps the current value.

    A changed kind resets delimiters and chart. Identity columns cannot be overridden, so
    personal data never reaches an analysis output.
    """
    wish = overrides.select(
        "survey_id", "q_key", F.col("kind").alias("_k"), F.col("chart").alias("_c")
    )
    df = questions.join(wish, ["survey_id", "q_key"], "left")
    open_ = F.col("identity").isNull()
    changed = open_ & F.col("_k").isNotNull() & (F.col("_k") != F.col("kind"))
    safe = F.array(*[F.lit(d) for d in SAFE_DELIMITERS])
    cut = F.when(F.col("_k") == "multiple", safe).otherwise(F.array().cast("array<string>"))
    default = F.lit("none")
    for kind, chart in KINDS_CHART.items():
        default = F.when(F.col("_k") == kind, chart).otherwise(default)
    chart = F.when(changed, default).otherwise(F.col("chart"))
    return df.withColumns(
        {
            "delimiters": F.when(changed, cut).otherwise(F.col("delimiters")),
            "chart": F.when(open_, F.coalesce("_c", chart)).otherwise(F.col("chart")),
            "kind": F.when(changed, F.col("_k")).otherwise(F.col("kind")),
        }
    ).select(*questions.columns)


def select_questions(questions: DataFrame, selection: DataFrame) -> DataFrame:
    """Apply selection(survey_id, q_key, selected) to questions that may be selected."""
    wish = selection.select("survey_id", "q_key", F.col("selected").alias("_s"))
    selectable = (F.col("kind") != "ignore") & F.col("identity").isNull()
    return (
        questions.join(wish, ["survey_id", "q_key"], "left")
        .withColumn(
            "selected",
            F.when(selectable, F.coalesce("_s", "selected")).otherwise(F.col("selected")),
        )
        .select(*questions.columns)
    )


def select_all(questions: DataFrame, selected: bool) -> DataFrame:
    selectable = (F.col("kind") != "ignore") & F.col("identity").isNull()
    return questions.withColumn(
        "selected", F.when(selectable, F.lit(selected)).otherwise(F.col("selected"))
    )


def column_report(questions: DataFrame, option_totals: DataFrame) -> DataFrame:
    """What was recognised per column; option counts only for kinds that have options."""
    counted = option_totals.select("survey_id", "q_key", F.col("options").alias("_n"))
    has_options = ~F.col("kind").isin("free", "ignore") & F.col("selected")
    return questions.join(counted, ["survey_id", "q_key"], "left").select(
        "survey_id",
        "q_ord",
        "q_key",
        "header",
        "label",
        "kind",
        F.when(F.col("inferred"), "inferred").otherwise(F.col("profile_key")).alias("origin"),
        F.when(has_options, F.coalesce("_n", F.lit(0))).alias("options"),
    )


def chart_series(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Chart-ready labels and counts of questions that have a chart."""
    shown = questions.where(
        ~F.col("kind").isin("free", "ignore") & (F.col("chart") != "none") & F.col("selected")
    ).select("survey_id", "q_key", "chart")
    return items.join(shown, ["survey_id", "q_key"]).select(
        "survey_id", "q_key", "chart", "rank", "label", "count", "percentage"
    )
