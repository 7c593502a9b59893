"""Text as numpy arrays inside Arrow batches, and small Spark helpers shared by the operators.

Texts are handled in slices of about a megabyte, so a task's memory does not depend on how many
rows Spark puts in a batch. A single text is always handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyweave.session import pin, ship, tune

SLICE_BYTES = 1 << 20

# ASCII white space: blank and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators, and the package on the workers; explicit settings win.

    Rows hold whole texts, so batches of the usual number of rows take tens of megabytes several
    times over in the executor and its Python workers.
    """
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, "2000")
    return ship(tune(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, rows_per_task: int = 20_000) -> tuple[DataFrame, int]:
    """A result kept as a checkpoint, in no more partitions than its rows need, and its row count.

    Results much smaller than the tables they come from would otherwise be read, and shuffled
    again, by as many tasks as those. The rows are counted while they are written.
    """
    seen = Observation()
    kept = pin(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    count = seen.get["rows"]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-count // rows_per_task))
    return kept.coalesce(tasks), count


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Size of all texts; one scan of one column."""
    return docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + mix(np.array([seed], np.uint64)))


BYTE_VALUES = (seeded(256, 1), seeded(256, 2))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)])
    return _powers, _inverses


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans at once, from prefix sums.

    `values` are 64-bit values of the symbols. The sum of value * base**position is brought to a
    common origin by the base's inverse, so equal sequences have equal hashes wherever they are.
    """
    powers, inverses = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def rolling_sums(values: np.ndarray, k: int) -> np.ndarray:
    """As span_hashes for every run of k values, not yet mixed: the upper bits are spread well."""
    powers, inverses = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    found = sums[k:] - sums[:-k]
    found *= inverses[: len(found)]
    return found


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about `limit` bytes."""
    data, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(rows, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that do not cross rows: starts, ends, and each row's first run.

    The last has one entry more than there are rows: runs of row r are bounds[r]:bounds[r + 1].
    """
    n = len(inside)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows(values: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every run of k consecutive symbols inside one row."""
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(values))
    whole = starts + k <= bounds[1:][rows] if len(rows) else np.zeros(0, bool)
    return starts[whole], rows[whole]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return many, later


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a run of k that starts at one of `starts`."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + k, n), -1)
    return np.cumsum(change[:-1]) > 0
