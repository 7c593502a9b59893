import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyweave-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-ckpt-"))
    yield session


def column(spark, values, build, result="v"):
    """Apply a Column function to a list of values and return the results in order."""
    from pyspark.sql import functions as F

    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string")
    out = df.select("i", build(F.col("s")).alias(result)).collect()
    return [r[result] for r in sorted(out)]
