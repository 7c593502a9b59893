"""Summaries and histograms of numeric questions, all questions at once.

Inputs are answer units, so every step works on distinct values with their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.constants import (
    DISCRETE_BIN_LIMIT,
    MAX_BIN_CANDIDATES,
    NICE_MANTISSAS,
    RANGE_MARK,
)
from tallyweave.functions.numbers import display, percentage, tidy
from tallyweave.functions.text import let
from tallyweave.operators.joins import dim_join
from tallyweave.operators.units import KEY
from tallyweave.session import pin


def value_counts(units: DataFrame) -> DataFrame:
    """(keys, value, c): finite values and how many respondents gave them."""
    finite = F.abs(F.col("num")) < F.lit(float("inf"))
    return (
        units.where(F.col("num").isNotNull() & finite)
        .groupBy(*KEY, F.col("num").alias("value"))
        .agg(F.sum("n").alias("c"))
    )


# ---- order statistics ---------------------------------------------------------------------


def _head(value: Column, digits: int) -> Column:
    """First significant digits of a value as a struct that sorts like the value."""

    def parts(text: Column) -> Column:
        sign = F.signum(value).cast("int")
        exponent = F.substring_index(text, "e", -1).cast("int")
        held = F.concat(F.substring(text, 1, 1), F.substring(text, 3, digits - 1)).cast("bigint")
        return F.struct(
            sign.alias("sign"), (sign * exponent).alias("exponent"), (sign * held).alias("digits")
        )

    return let(F.format_string("%.16e", F.abs(value)), parts)


def order_statistics(values: DataFrame) -> DataFrame:
    """p25, median and p75 without interpolation, exact and without a large sort group.

    Three levels, like a radix selection: counts per head of six digits locate the head holding
    each wanted position, counts of twelve digits under that head locate a closer one, and only
    the values under it are ordered. A double has seventeen significant digits, so the two lower
    levels order at most a million rows per question and statistic, however the values lie.
    """
    n = F.col("n")
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("stat"), position.cast("bigint").alias("position"))
            for name, position in (
                ("p25", F.least(n - 1, F.floor(n * 0.25))),
                ("low", F.floor((n - 1) / 2)),
                ("high", F.floor(n / 2)),
                ("p75", F.least(n - 1, F.floor(n * 0.75))),
            )
        ]
    )
    headed = values.withColumn("head", _head(F.col("value"), 6))
    group = Window.partitionBy(*KEY)
    heads = (
        headed.groupBy(*KEY, "head")
        .agg(F.sum("c").alias("c"))
        .withColumn("n", F.sum("c").over(group))
        .withColumn("before", F.sum("c").over(group.orderBy("head")) - F.col("c"))
        .withColumn(
            "hits",
            F.filter(
                wanted,
                lambda w: (w["position"] >= F.col("before"))
                & (w["position"] < F.col("before") + F.col("c")),
            ),
        )
        .where(F.size("hits") > 0)
        .select(*KEY, "head", "before", F.inline("hits"))
    )
    # At most four heads per question, so values are not moved to meet them.
    under = dim_join(headed, heads, [*KEY, "head"], "value").withColumn("closer", _head(F.col("value"), 12))
    inside = Window.partitionBy(*KEY, "stat")
    closer = (
        under.groupBy(*KEY, "stat", "position", "before", "closer")
        .agg(F.sum("c").alias("c"))
        .withColumn("before", F.col("before") + F.sum("c").over(inside.orderBy("closer")) - F.col("c"))
        .where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("c")))
        .select(*KEY, "stat", "closer", F.col("before").alias("start"))
    )
    located = (
        dim_join(under, closer, [*KEY, "stat", "closer"], "value")
        .withColumn("upto", F.col("start") + F.sum("c").over(inside.orderBy("value")))
        .where(F.col("upto") > F.col("position"))
        .groupBy(*KEY, "stat")
        .agg(F.min("value").alias("value"))
    )
    pick = lambda name: F.max(F.when(F.col("stat") == name, F.col("value")))
    return (
        located.groupBy(*KEY)
        .agg(*[pick(s).alias(s) for s in ("p25", "low", "high", "p75")])
        .select(
            *KEY,
            "p25",
            F.when(F.col("low") == F.col("high"), F.col("low"))
            .otherwise(tidy((F.col("low") + F.col("high")) / 2))
            .alias("median"),
            "p75",
        )
    )


def numeric_summary(units: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """n, min, max, mean, median, p25, p75, sum and unparsed per numeric question."""
    # Read by the basics and twice by the order statistics.
    values = pin(value_counts(units)) if values is None else values
    basics = values.groupBy(*KEY).agg(
        F.sum("c").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        tidy(F.sum(F.col("value") * F.col("c"))).alias("sum"),
    )
    unparsed = (
        units.where(F.col("kind") == "numeric")
        .groupBy(*KEY)
        .agg(F.sum(F.when(F.col("answered") & F.col("num").isNull(), F.col("n")).otherwise(0)).alias("unparsed"))
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    return (
        unparsed.join(basics, KEY, "left")
        .join(order_statistics(values), KEY, "left")
        .select(
            *KEY,
            F.coalesce("n", F.lit(0)).alias("n"),
            zero("min"),
            zero("max"),
            F.coalesce(tidy(F.col("sum") / F.col("n")), F.lit(0.0)).alias("mean"),
            zero("median"),
            zero("p25"),
            zero("p75"),
            zero("sum"),
            "unparsed",
        )
    )


# ---- histogram layout ---------------------------------------------------------------------


def _start(low: Column, width: Column) -> Column:
    return tidy(F.floor(tidy(low / width)) * width)


def _bin_count(low: Column, high: Column, width: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(tidy((high - _start(low, width)) / width)).cast("int"))


def _nice_width(low: Column, high: Column) -> Column:
    """1, 2 or 5 times a power of ten; 6 to 12 bins are best, ties take the finer width."""
    magnitude = F.floor(F.log10(high - low)).cast("int")
    powers = F.sequence(magnitude - 3, magnitude + 2)
    widths = F.flatten(
        F.transform(
            powers,
            lambda e: F.array(*[tidy(F.lit(float(m)) * F.pow(F.lit(10.0), e)) for m in NICE_MANTISSAS]),
        )
    )

    def scored(w: Column) -> Column:
        def score(k: Column) -> Column:
            off = F.when(k < 6, 6 - k + 0.5).when(k > 12, (k - 12).cast("double")).otherwise(0.0)
            return F.struct(off.alias("score"), w.alias("width"), k.alias("bins"))

        return let(_bin_count(low, high, w), score)

    usable = F.filter(F.transform(widths, scored), lambda s: s["bins"] <= MAX_BIN_CANDIDATES)
    return F.coalesce(F.array_min(usable)["width"], F.lit(1.0))


def bin_layout(values: DataFrame) -> DataFrame:
    """One row per question: how its values are binned."""
    value = F.col("value")
    spread = values.groupBy(*KEY).agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count(F.lit(1)).alias("distinct"),
        F.max(value != F.floor(value)).alias("has_fraction"),
    )
    laid = spread.withColumn("discrete", F.col("distinct") <= DISCRETE_BIN_LIMIT)
    low, high, width = F.col("low"), F.col("high"), F.col("width")
    laid = laid.withColumn("width", F.when(~F.col("discrete"), _nice_width(low, high)))
    laid = laid.withColumn("start", _start(low, width)).withColumn(
        "bins", _bin_count(low, high, width)
    )
    fractional = (
        F.col("has_fraction")
        | (width != F.floor(width))
        | (F.col("start") != F.floor(F.col("start")))
    )
    decimals = (
        F.when(F.col("discrete"), F.col("has_fraction").cast("int"))
        .when(~fractional, 0)
        .when(width >= 0.1, 1)
        .when(width >= 0.01, 2)
        .when(width >= 0.001, 3)
        .otherwise(4)
    )
    laid = laid.withColumn("decimals", decimals)
    steps = F.array(*[F.lit(s) for s in (1.0, 0.1, 0.01, 0.001, 0.0001)])
    return laid.withColumn("step", F.get(steps, F.col("decimals"))).select(
        *KEY, "discrete", "high", "width", "start", "bins", "decimals", "step"
    )


def bin_index(value: Column) -> Column:
    """Bin of a value under a joined layout; the last bin also holds the maximum."""
    raw = F.floor(tidy((value - F.col("start")) / F.col("width"))).cast("int")
    return F.least(F.col("bins") - 1, F.greatest(F.lit(0), raw))


def with_bin(df: DataFrame, value: str, index: str, unit: str = "unit") -> DataFrame:
    """Add `bin_from`, `bin_to` and `bin_label` for a joined layout, a value and a bin index."""
    i, v = F.col(index), F.col(value)
    discrete, step, high = F.col("discrete"), F.col("step"), F.col("high")
    low_edge = tidy(F.col("start") + i * F.col("width"))
    next_edge = tidy(F.col("start") + (i + 1) * F.col("width"))
    df = df.withColumn("bin_from", F.when(discrete, v).otherwise(low_edge))
    df = df.withColumn("bin_to", F.when(discrete, v).otherwise(next_edge))
    below_next = tidy(F.col("bin_to") - step)
    is_last = i == F.col("bins") - 1
    df = df.withColumn(
        "_upper",
        F.when(discrete, v).when(is_last, F.greatest(below_next, high)).otherwise(below_next),
    )
    decimals, suffix = F.col("decimals"), F.coalesce(unit, F.lit(""))
    first, last = display(F.col("bin_from"), decimals), display(F.col("_upper"), decimals)
    single = F.col("bin_from") == F.col("_upper")
    label = F.when(single, F.concat(first, suffix)).otherwise(
        F.concat(first, F.lit(RANGE_MARK), last, suffix)
    )
    return df.withColumn("bin_label", label).drop("_upper")


def labelled_bins(values: DataFrame, layout: DataFrame, units_of_measure: DataFrame) -> DataFrame:
    """(keys, value, index, bin_from, bin_to, bin_label): every bin of every question.

    At most ten rows per discrete question and MAX_BIN_CANDIDATES per other question; `value`
    is NULL for range bins and `index` is 0 for discrete ones.
    """
    discrete = dim_join(values, layout.where("discrete"), KEY, "value").select(
        *KEY, "value", F.lit(0).alias("index"), *_LAYOUT
    )
    ranges = layout.where("not discrete").select(
        *KEY,
        F.lit(None).cast("double").alias("value"),
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("index"),
        *_LAYOUT,
    )
    bins = discrete.unionByName(ranges).join(units_of_measure, KEY)
    return with_bin(bins, "value", "index").select(
        *KEY, "value", "index", "bin_from", "bin_to", "bin_label"
    )


def bin_lookup(values: DataFrame, units_of_measure: DataFrame) -> DataFrame:
    """One row per question: its layout with the bins' lower edges and labels as arrays."""
    layout = bin_layout(values)
    edges = labelled_bins(values, layout, units_of_measure).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("bin_from", "bin_label"))).alias("_bins")
    )
    return layout.join(edges, KEY).select(
        *KEY,
        *_LAYOUT,
        F.transform("_bins", lambda b: b["bin_from"]).alias("edges"),
        F.transform("_bins", lambda b: b["bin_label"]).alias("labels"),
    )


def looked_up_label(value: Column) -> Column:
    """Bin label of a value under a joined lookup row; NULL without a value or a layout."""
    position = F.array_position("edges", value).cast("int") - 1
    index = F.when(F.col("discrete"), position).otherwise(bin_index(value))
    return F.when(value.isNotNull(), F.get("labels", index))


def histogram(
    values: DataFrame, units_of_measure: DataFrame, valid: DataFrame
) -> DataFrame:
    """Bins of every numeric question in bin order; empty bins are kept with count 0.

    `units_of_measure` gives (keys, unit), `valid` gives (keys, valid); shares are over all
    valid answers, including those that could not be read as a number.
    """
    layout = bin_layout(values)
    placed = dim_join(values, layout, KEY, "value")
    exact = F.col("discrete")
    # Discrete bins are matched by value, range bins by index.
    counted = (
        placed.withColumn("value_", F.when(exact, F.col("value")))
        .withColumn("index", F.when(exact, 0).otherwise(bin_index(F.col("value"))))
        .groupBy(*KEY, F.col("value_").alias("value"), "index")
        .agg(F.sum("c").alias("count"))
    )
    bins = labelled_bins(values, layout, units_of_measure)
    same = [bins[k] == counted[k] for k in (*KEY, "index")]
    found = bins.join(counted, [*same, bins["value"].eqNullSafe(counted["value"])], "left").select(
        *[bins[k] for k in KEY],
        "bin_from",
        "bin_to",
        "bin_label",
        F.coalesce(counted["count"], F.lit(0)).alias("count"),
    )
    order = Window.partitionBy(*KEY).orderBy("bin_from")
    return found.join(valid, KEY).select(
        *KEY,
        F.row_number().over(order).cast("bigint").alias("rank"),
        F.col("bin_label").alias("label"),
        "bin_from",
        "bin_to",
        "count",
        percentage(F.col("count"), F.col("valid")).alias("percentage"),
    )


_LAYOUT = ("discrete", "high", "width", "start", "bins", "decimals", "step")
