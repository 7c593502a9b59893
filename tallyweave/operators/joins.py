"""Joins of a large table with a dimension whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A dimension up to this many rows is broadcast. Its rows are per-question metadata of a few
# KB at most (presets, aliases, at most MAX_BIN_CANDIDATES bin labels), so about 40 MB in all.
BROADCAST_ROWS = 5_000
SALTS = 32


def dim_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: str,
    rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join facts with a dimension: broadcast when small, else salted on both sides.

    `rows` is the dimension's size when known; otherwise it is counted, up to the bound.
    Beyond the bound the dimension is repeated per salt so that one hot key of the facts,
    spread by `spread_by`, is shared by many tasks.
    """
    if rows is None:
        rows = 0 if is_small(dim) else BROADCAST_ROWS + 1
    if rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dim), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return grown_join(salted, repeated, [*on, "_salt"], how).drop("_salt")


def is_small(dim: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most `bound` rows; stops counting beyond it."""
    return dim.limit(bound + 1).count() <= bound


def grown_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input; neither is broadcast.

    Sizes are estimated from compressed files and not counted again when rows are exploded or
    made in Python, so without the hint a table of millions of rows may pass for a small one.
    """
    return left.join(right.hint("merge"), on, how)
