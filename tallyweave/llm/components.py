"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from tallyweave.llm.common import settled
from tallyweave.session import pin

# Edges of one task that contracts them: 16 bytes each, some ten times that at work.
TASK_EDGES = 500_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the smallest node reachable from each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        a, b = label[one], label[two]
        apart = a != b
        if not apart.any():
            return nodes, nodes[label]
        # The larger root of each edge is hooked to the smaller one; then all paths are halved to their roots.
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges as stars around the smallest node of each of its components."""
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, least = smallest_reachable(table["u"].to_numpy(), table["v"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["u", "v"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b).

    Each task contracts a bounded number of edges to stars. If the edges were one task's, that is
    the result. Else alternating large-star and small-star steps link nodes to the smallest one
    they know, so paths shrink by halves and the number of rounds grows with the logarithm of the
    longest path. Edges never leave the executors; each round is kept as a checkpoint.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, count = settled(edges)
    tasks = max(1, -(-count // task_edges))
    edges = edges.coalesce(tasks).mapInArrow(_contract, "u bigint, v bigint")
    if tasks == 1:
        return pin(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
    edges = edges.where("u <> v")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
        edges = linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = pin(edges.observe(seen, F.count(F.lit(1)).alias("rows"), digest))
        now = seen.get
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pin(leaves.unionByName(roots))
