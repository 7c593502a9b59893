"""Exact positions within a group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.session import pin

# Groups up to this many rows are numbered by one window task each.
WINDOW_ROWS = 500_000
RANGE_PARTITIONS = 256


def ranked(
    df: DataFrame,
    part: list[str],
    order: list[Column],
    into: str = "rank",
    max_group: int = WINDOW_ROWS,
    partitions: int = RANGE_PARTITIONS,
    at_most: int | None = None,
) -> DataFrame:
    """Number rows 1, 2, ... within each group.

    Small groups use one window. When a group is larger, rows are range-partitioned by (group,
    order), numbered inside each range, and shifted by the sizes of the group's earlier ranges.
    `at_most` is a known bound on the rows; where it does not settle the matter, the input is
    pinned and its largest group measured.
    """
    if at_most is None or at_most > max_group:
        df = pin(df)
        at_most = df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
    if at_most <= max_group:
        window = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(into, F.row_number().over(window).cast("bigint"))

    # The range of a row must not change between the two uses below, hence the second pin.
    ranged = pin(
        df.repartitionByRange(partitions, *[F.col(p) for p in part], *order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    inside = Window.partitionBy(*part, "_range").orderBy(*order)
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        ranged.groupBy(*part, "_range")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    numbered = ranged.withColumn("_local", F.row_number().over(inside))
    return (
        numbered.join(shifts, [*part, "_range"])
        .withColumn(into, F.col("_local") + F.col("_shift"))
        .drop("_local", "_shift", "_range")
    )
