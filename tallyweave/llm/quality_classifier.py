"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's features are its words and marks (runs of other printable characters) and its pairs of
neighbouring words, hashed into a fixed number of buckets and scaled to unit length. The pair of
a word with itself is one feature, whatever the word. The model is fitted by FTRL-Proximal
updates, one labelled text after another, on a bounded sample; scoring is a sparse dot product
per text over the whole table.

Null or empty texts have no features: their score is that of the bias alone. Rows with a null
label are not learned from; several labels of one id count as the smallest. Repeated rows are
scored each. Further columns of the input are kept, except that an existing column with the name
of a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyweave.llm.common import (
    BYTE_VALUES, LOWER, SPACE, free_name, mix, runs, seeded, slices, span_hashes,
)

BUCKETS = 1 << 18
# Bound of the learning sample; labelled rows are taken by a hash of their id.
MAX_SAMPLE = 8_000
EPOCHS = 4
THRESHOLD = 0.3

_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PAIR, _TWICE = seeded(2, 11)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.02


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every non-zero feature, sorted by row."""
    values = BYTE_VALUES[0][LOWER[data]]
    found_rows, found = [], []
    for inside in (_WORDY[data], ~_WORDY[data] & ~SPACE[data]):
        starts, ends, bounds = runs(inside, offsets)
        hashes = span_hashes(values, starts, ends)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        found_rows.append(rows)
        found.append(hashes)
        if not len(found) > 1 and len(hashes) > 1:
            left, right = hashes[:-1], hashes[1:]
            pairs = mix(left * _PAIR + right)
            pairs[left == right] = _TWICE
            together = rows[1:] == rows[:-1]
            found_rows.append(rows[1:][together])
            found.append(pairs[together])
    rows, buckets = np.concatenate(found_rows), np.concatenate(found) % np.uint64(BUCKETS)
    cells, counts = np.unique(rows.astype(np.int64) * BUCKETS + buckets.astype(np.int64), return_counts=True)
    rows, buckets = cells // BUCKETS, cells % BUCKETS
    norms = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(offsets) - 1))
    return rows, buckets, counts / norms[rows]


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], setting: Ftrl = Ftrl()) -> np.ndarray:
    """Weights by FTRL-Proximal; the last one is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        shrunk = np.maximum(np.abs(z[at]) - setting.l1, 0)
        return -np.sign(z[at]) * shrunk / ((setting.beta + np.sqrt(n[at])) / setting.alpha + setting.l2)

    for _ in range(EPOCHS):
        for buckets, values, label in examples:
            at, x = np.r_[buckets, BUCKETS], np.r_[values, 1.0]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / setting.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column("text")):
            rows, buckets, values = features(data, offsets)
            cuts = np.searchsorted(rows, np.arange(end - first + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rank").slice(first, end - first),
                    batch.column("label").slice(first, end - first),
                    pa.array([buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([values[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                ["rank", "label", "buckets", "values"],
            )


def _fit_group(sample: pa.Table) -> pa.Table:
    order = np.lexsort((sample["label"].to_numpy(), sample["rank"].to_numpy()))
    labels = sample["label"].to_pylist()
    buckets, values = sample["buckets"].to_pylist(), sample["values"].to_pylist()
    examples = [
        (np.frombuffer(buckets[i], np.int32), np.frombuffer(values[i], np.float32).astype(float), labels[i])
        for i in order
    ]
    return pa.table({"weights": pa.array([fit(examples).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_sample: int = MAX_SAMPLE) -> np.ndarray:
    """Weights learned from at most about `max_sample` labelled rows.

    `labels` holds doc_id and the label; leave out held-out rows before. The sample is the rows
    whose hashed id falls below a bound, so it does not depend on partitions. It is fitted in
    one task, in order of the hash; its size is bounded whatever the tables' sizes are.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    share = min(1.0, max_sample / max(1, known.count()))
    rank = F.xxhash64(F.lit(5), "doc_id")
    if share < 1:
        known = known.where(F.shiftright(rank, 11).cast("double") < F.lit((2 * share - 1) * 2.0**52))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select(rank.alias("rank"), "label", F.coalesce("text", F.lit("")).alias("text"))
    examples = rows.mapInArrow(_example_rows, "rank bigint, label int, buckets binary, values binary")
    found = examples.groupBy(F.lit(0).alias("model")).applyInArrow(_fit_group, "weights binary").collect()
    if not found:
        return np.zeros(BUCKETS + 1, np.float32)
    return np.frombuffer(found[0].weights, np.float32)


def score(docs: DataFrame, weights: np.ndarray, into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of label 1 to the kept columns (all, unless named) of every row.

    `weights` are a fixed number of values, so sending them to all tasks is bounded.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    carried = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(free_name(docs, "scored_text")))
    schema = T.StructType([*carried.schema[: len(kept)], T.StructField(into, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))
    out_schema = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(float)
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(len(kept))):
                rows, buckets, values = features(data, offsets)
                dots = np.bincount(rows, values * w[buckets], end - first) + w[-1]
                chance = 1 / (1 + np.exp(-np.clip(dots, -700, 700)))
                part = batch.slice(first, end - first)
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(chance)], schema=out_schema)

    return carried.mapInArrow(scored, schema)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    into = free_name(docs, "score")
    scored = score(docs, train(docs, labels.where(remainder() != 0)), into)
    return scored.where(F.col(into) >= threshold).drop(into)


def remainder():
    """crc32 of the id as text, modulo 5: 0 marks held-out rows."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    weights = train(docs, labels.where(remainder() != 0))
    return score(docs, weights, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
