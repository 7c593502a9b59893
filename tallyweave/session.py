"""Session helpers: where checkpoints go and how results are pinned."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names, else one in the warehouse, which executors share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def pin(df: DataFrame) -> DataFrame:
    """Write a result once to the shared checkpoint folder and cut its lineage.

    For results that are read several times and must be identical each time; survives the
    loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators are designed for; explicit user settings win.

    Distinct cells are few bytes but cost CPU each, so small shuffle partitions must not be
    merged into one task. Large shuffles are unaffected: their partitions exceed the minimum.
    """
    wanted = {
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": ("1MB", "64KB"),
    }
    for key, (default, value) in wanted.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by Python workers, as `--py-files` would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tallyweave-py-"), "tallyweave.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def spread(scan: DataFrame, evenly: bool = False) -> DataFrame:
    """Give a scan of few input splits one task per core; large inputs pass unchanged.

    For plain scans ahead of CPU-heavy row work only. Splits follow the bytes of files, and a
    split without the start of a row group is empty: `evenly` deals out the rows in any case.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    parts = scan.rdd.getNumPartitions()
    if evenly:
        return scan.repartition(max(4 * cores, parts))
    return scan if parts >= cores else scan.repartition(cores)


def staged(df: DataFrame, keep=None, **columns: Column) -> DataFrame:
    """Add computed columns behind a generator, so each is evaluated once per row.

    A plain projection may be copied into every later use and into pushed-down filters. With
    `keep`, a function of the new struct, rows that fail it are dropped in the same step.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(made if keep is None else F.filter(made, keep)))
