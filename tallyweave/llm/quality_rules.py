"""Quality rules: plain counts, and robust multivariate outliers per language and source.

The counts follow from the text alone. They are turned into a vector of transformed statistics,
and each group (language and source) gets a minimum-covariance-determinant estimate of centre and
spread: concentration steps from three fixed starts, each step keeping the most central part of the
group and re-estimating from it, the start with the smallest determinant winning. A text is
rejected when its Mahalanobis distance exceeds a quantile of the chi-square distribution.

Most texts of a group may repeat nothing and hold no symbol, and the covariance of its central part
is then singular. As in the minimum regularised covariance determinant, a target matrix is added to
it, in the estimate and in the determinant that is minimised. The target comes from the rows: it is
diagonal and holds each statistic's mean sampling variance in the group, which is how far a
statistic moves by chance when a text of that length is drawn again. It matters only for
statistics that vary by hardly more than that. A text is judged by its own sampling variances where
they exceed the group's: ten words have a less certain mean length than a thousand.

All rows of a group take part in every step, as sums Spark combines before its shuffle, so a hot
source costs no more than an even one. Groups with fewer than `min_group` usable rows are pooled
by language, then altogether; a pool that is still smaller rejects nothing. Estimates are one row
per group and stay a table.

Null texts count as empty: all counts zero, failed by the base rule. Null languages and sources
form groups of their own. Repeated rows are judged each. Columns that are not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import (
    BYTE_VALUES, SPACE, covered, mix, repeated, runs, slices, span_hashes, windows,
)
from tallyweave.operators.joins import dim_join
from tallyweave.session import pin

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
# The central part of a group is its share of rows, right to one in that many.
ACCURACY = 10_000
_CONTINUED = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Rule:
    """Parameters of the outlier rule."""

    coverage: float = 0.75
    steps: int = 4
    min_group: int = 60
    tail: float = 1e-6


def _per_row(marks: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows[marks], minlength=n).astype(np.int64)


def counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The base counts of every row, in the order of BASE."""
    n, values = len(offsets) - 1, BYTE_VALUES[0][data]
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    starts, ends, bounds = runs(~SPACE[data], offsets)
    words = span_hashes(values, starts, ends)
    n_words = np.diff(bounds)

    at, rows = windows(words, bounds, 5)
    many, _ = repeated(span_hashes(words, at, at + 5) ^ salt[rows]) if len(at) else (np.zeros(0, bool), None)
    again = covered(at[many], 5, len(words))
    word_rows = np.repeat(np.arange(n), n_words)

    line_starts, line_ends, line_bounds = runs(data != 10, offsets)
    line_rows = np.repeat(np.arange(n), np.diff(line_bounds))
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = span_hashes(values, line_starts[wordy], line_ends[wordy]) ^ salt[line_rows[wordy]]
    _, later = repeated(lines)
    return [
        n_words.astype(np.int64),
        _per_row(~SPACE[data] & ~_CONTINUED[data], row_of, n),
        _per_row(_SYMBOLS[data], row_of, n),
        _per_row(later, line_rows[wordy], n),
        _per_row(again, word_rows, n),
    ]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column("text")):
            kept = batch.slice(first, end - first)
            found = [pa.array(c) for c in counts(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [kept.column("doc_id"), kept.column("lang"), kept.column("source"), *found],
                ["doc_id", "lang", "source", *BASE],
            )


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and base_failed of every row."""
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in BASE)
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), "text"
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.mapInArrow(_count_batches, schema).withColumn("base_failed", failed)


def statistics() -> list[Column]:
    """Transformed statistics; every one is finite for any counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log1p(words),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def sampling_variances() -> list[Column]:
    """How much each statistic varies by chance alone, by the delta method on Poisson counts.

    The logarithm of a count n varies by 1 / n, a square root by a quarter of what one event adds
    to its square. A repeat adds two windows, of five words each.
    """
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [1 / words, 1 / chars, 0.25 / chars, 0.25 / words, 0.25 * 10 / words]


DIM = 5
_VEC = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def chi_square(x: float, k: int) -> float:
    """Distribution function of the chi-square distribution with k degrees of freedom."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_at(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """Each row's group: (lang, source), or a pool for rows of small groups."""
    own = F.to_json(F.struct(F.lit(0).alias("pool"), "lang", "source"))
    by_lang = F.to_json(F.struct(F.lit(1).alias("pool"), "lang"))
    sizes = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("size"))
    small = F.col("size") < min_group
    pools = sizes.where(small).groupBy("lang").agg(F.sum("size").alias("pool_size"))
    named = sizes.select("lang", "source", "size").join(
        pools.select(F.col("lang").alias("pool_lang"), "pool_size"), F.col("lang").eqNullSafe(F.col("pool_lang")), "left"
    )
    group = F.when(~small, own).when(F.col("pool_size") >= min_group, by_lang).otherwise("rest")
    named = named.select(own.alias("own"), group.alias("grp"))
    return dim_join(rows.withColumn("own", own), pin(named), ["own"], "doc_id", how="left").drop("own")


def _distance(estimate: str, noise: str | None = None) -> Column:
    """Squared Mahalanobis distance to the centre and inverse spread held in an array column.

    With `noise`, the group's mean sampling variances, a text whose own ones are larger is judged
    by variances that are larger by the difference, under the same correlations.
    """
    total = F.lit(0.0)
    away = [F.col(x) - F.col(estimate)[i] for i, x in enumerate(_VEC)]
    if noise:
        usual = [F.col(estimate)[DIM + len(_PAIRS) + i] for i in range(DIM)]
        more = [F.greatest(v - F.col(noise)[i], F.lit(0.0)) for i, v in enumerate(sampling_variances())]
        away = [a * F.sqrt(u / (u + m)) for a, u, m in zip(away, usual, more)]
    for at, (i, j) in enumerate(_PAIRS):
        total = total + away[i] * away[j] * F.col(estimate)[DIM + at] * (1 if i == j else 2)
    return total


def _invert(batches: Iterator[pd.DataFrame], scale: float) -> Iterator[pd.DataFrame]:
    """Centre, inverse spread, variances and log determinant from each group's sums."""
    for sums in batches:
        made, dets = [], []
        for row in sums.itertuples():
            n, v = row.n, np.asarray(row.sums, float)
            centre = v[:DIM] / n
            spread = np.zeros((DIM, DIM))
            for at, (i, j) in enumerate(_PAIRS):
                spread[i, j] = spread[j, i] = (v[DIM + at] / n - centre[i] * centre[j]) * scale
            spread[np.diag_indices(DIM)] += np.asarray(row.noise, float)
            inverse = np.linalg.inv(spread)
            made.append([*centre, *[inverse[i, j] for i, j in _PAIRS], *np.diag(spread)])
            dets.append(float(np.linalg.slogdet(spread)[1]))
        yield pd.DataFrame({"grp": sums["grp"], "start": sums["start"], "n": sums["n"], "estimate": made, "det": dets})


def _estimates(rows: DataFrame, noise: DataFrame, scale: float) -> DataFrame:
    sums = [F.sum(x) for x in _VEC] + [F.sum(F.col(_VEC[i]) * F.col(_VEC[j])) for i, j in _PAIRS]
    summed = rows.groupBy("grp", "start").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
    schema = "grp string, start int, n bigint, estimate array<double>, det double"
    return pin(summed.join(noise, "grp").mapInPandas(lambda b: _invert(b, scale), schema))


def _starts() -> Column:
    """(start, d): all rows alike; then the rows nearest to the medians, in units of the sampling
    deviations and of the quartiles' distance."""
    away = [F.col(x) - F.col("quarters")[i][1] for i, x in enumerate(_VEC)]
    by_noise = sum(a * a / F.col("noise")[i] for i, a in enumerate(away))
    widths = [F.col("quarters")[i][2] - F.col("quarters")[i][0] for i in range(DIM)]
    by_width = sum(a * a / (w * w + F.col("noise")[i]) for i, (a, w) in enumerate(zip(away, widths)))
    found = [F.lit(0.0), by_noise, by_width]
    return F.inline(F.array(*[F.struct(F.lit(k).alias("start"), d.alias("d")) for k, d in enumerate(found)]))


def judge(rows: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Add `distance` (null where no estimate exists) and `outlier` to rows of base counts."""
    rows = rows.select("*", *[c.alias(x) for c, x in zip(statistics(), _VEC)])
    rows = pin(_groups(rows, rule.min_group))
    usable = rows.where("NOT base_failed AND grp IS NOT NULL")
    quarters = F.array(*[F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY) for x in _VEC])
    noise = F.array(*[F.avg(v) for v in sampling_variances()])
    known = pin(usable.groupBy("grp").agg(quarters.alias("quarters"), noise.alias("noise")))
    usable = usable.select("doc_id", "grp", *_VEC)
    scored = dim_join(usable, known, ["grp"], "doc_id").select("doc_id", "grp", *_VEC, _starts())
    # Variances of the central part of a normal sample are too small by a known factor.
    cut = chi_square_at(rule.coverage, DIM)
    scale = rule.coverage / chi_square(cut, DIM + 2)
    for _ in range(rule.steps):
        bounds = pin(scored.groupBy("grp", "start").agg(F.percentile_approx("d", rule.coverage, ACCURACY).alias("most")))
        central = dim_join(scored, bounds, ["grp", "start"], "doc_id").where("d <= most")
        estimates = _estimates(central, known.select("grp", "noise"), scale)
        scored = dim_join(usable, estimates, ["grp"], "doc_id").select(
            "doc_id", "grp", *_VEC, "start", _distance("estimate").alias("d")
        )
    best = estimates.groupBy("grp").agg(F.min_by(F.struct("estimate", "n"), F.struct("det", "start")).alias("best"))
    best = best.where(F.col("best.n") >= rule.coverage * rule.min_group * 0.9).select("grp", F.col("best.estimate").alias("estimate"))
    limit = chi_square_at(1 - rule.tail, DIM)
    best = pin(best.join(known.select("grp", "noise"), "grp"))
    judged = dim_join(rows, best, ["grp"], "doc_id", how="left")
    judged = judged.withColumn("distance", F.sqrt(_distance("estimate", "noise")))
    outlier = F.coalesce(F.col("distance") > math.sqrt(limit), F.lit(False))
    return judged.withColumn("outlier", outlier).drop("estimate", "noise", *_VEC)


def apply(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Base counts and the verdict of every row."""
    rows = pin(base_counts(docs))
    return judge(rows, rule).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
