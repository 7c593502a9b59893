"""Vector codes: product quantisation with codebooks fitted over tries of distinct parts.

Components become integers, vectors are cut into equal parts, and each part position has a small
codebook. A part's nearest entry is found in a trie: the distinct parts in lexicographic order,
one level per dimension. Going through it depth first, each node adds its dimension's squared
differences from all entries to those of its parent, so parts with a common prefix share that
work; a leaf takes the smallest sum, and its weight (how many vectors have the part) enters the
sums from which entries are made anew.

For fitting, distinct parts are made once by a combined grouping, dealt in lexicographic ranges
and kept; a round reads them in order, a block at a time, with the path of the last leaf carried
from block to block, and returns a few sums per task. Only codebooks (a fixed number of integers)
reach the driver. Codes are then written in one pass without a shuffle: every task goes through
the trie of its own vectors' parts.

Rows whose vector is null or empty, or holds a null, infinite or NaN component, are dropped, as are
vectors of another length than the smallest id's, or of a length that parts do not divide: they
have no parts to compare. Components beyond a bound at which all sums stay exact (2**27 after
scaling, for 64 dimensions) count as that bound. Repeated rows count each; the first entries go by
id, then by vector; rows without an id are coded, but start no entry. With fewer vectors than
entries the codebooks are shorter. Empty tables give no rows. Sums of errors beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import free_name
from tallyweave.operators.joins import dim_join
from tallyweave.session import pin

# Leaves of one block of a trie.
BLOCK = 4_096


@dataclass(frozen=True)
class Codes:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


class Trie:
    """Depth-first passes over sorted parts of one position; keeps the path to the last leaf."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.last: np.ndarray | None = None
        self.path: list[np.ndarray] = []

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and its distance for sorted rows; and how many nodes were new."""
        width = rows.shape[1]
        differs = np.ones((len(rows), width), bool)
        differs[1:] = rows[1:] != rows[:-1]
        if self.last is not None:
            differs[0] = rows[0] != self.last
        # A row makes a new node at every level from the first component that differs.
        fresh = np.logical_or.accumulate(differs, axis=1)
        above, at, path, made = np.zeros((1, len(self.book)), np.int64), np.zeros(len(rows), np.int64), [], 0
        for level in range(width):
            new = np.flatnonzero(fresh[:, level])
            made += len(new)
            sums = (rows[new, level, None] - self.book[None, :, level]) ** 2 + above[at[new]]
            # Place 0 is the node on the carried path, the others are new ones in order.
            before = self.path[level] if self.path else np.zeros(len(self.book), np.int64)
            above = np.concatenate([before[None], sums])
            at = np.cumsum(fresh[:, level])
            path.append(above[at[-1]])
        self.last, self.path = rows[-1], path
        # Equal parts share a leaf.
        entry = above.argmin(1)
        return entry[at], above[at, entry[at]], made


def _limit(dims: int) -> int:
    """Largest component for which a vector's squared distance stays below 2**63."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scaled(vectors: DataFrame, dims: int, codes: Codes, vector: str = "embedding") -> DataFrame:
    """The usable rows, with the vector replaced by an array of integers of `dims` components."""
    v = F.col(f"`{vector}`")
    usable = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    bound = float(_limit(dims))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x.cast("double") * codes.scale).cast("double"))).cast("bigint"))
    return vectors.where(usable).withColumn(vector, whole)


def dimensions(vectors: DataFrame, codes: Codes, id: str = "vec_id", vector: str = "embedding") -> int:
    """Length of the smallest id's usable vector; 0 if there is none."""
    v = F.col(f"`{vector}`")
    usable = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % codes.parts == 0)
    usable &= F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    first = F.struct(F.col(f"`{id}`").isNull().alias("none"), F.col(f"`{id}`").alias("id"), F.size(v).alias("size"))
    found = vectors.where(usable).agg(F.min(first).alias("first")).select("first.size").first()
    return found[0] or 0


def _distinct_parts(whole: DataFrame, dims: int, codes: Codes, vector: str) -> DataFrame:
    """position, part, weight: every distinct part once, in lexicographic ranges."""
    width = dims // codes.parts
    cut = F.array(*[F.struct(F.lit(i).alias("position"), F.slice(f"`{vector}`", i * width + 1, width).alias("part")) for i in range(codes.parts)])
    parts = whole.select(F.inline(cut)).groupBy("position", "part").agg(F.count("*").alias("weight"))
    return parts.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def _sums(books: np.ndarray):
    """Per task, position and entry: weight and weighted component sums of the parts nearest to it."""
    n_parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie(b) for b in books]
        counts = np.zeros((n_parts, n_entries), np.int64)
        totals = np.zeros((n_parts, n_entries, width), np.int64)
        for batch in batches:
            positions, rows, weights = batch.column("position").to_numpy(), _matrix(batch.column("part"), width), batch.column("weight").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(positions)) + 1, len(positions)]
            for a, b in zip(edges, edges[1:]):
                for at in range(a, b, BLOCK):
                    some = slice(at, min(b, at + BLOCK))
                    k = positions[a]
                    entry, _, _ = tries[k].leaves(rows[some])
                    np.add.at(counts[k], entry, weights[some])
                    np.add.at(totals[k], entry, rows[some] * weights[some, None])
        used = np.argwhere(counts > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(counts[tuple(used.T)]), pa.array(totals[tuple(used.T)].tolist(), pa.list_(pa.int64()))],
                ["position", "entry", "weight", "total"],
            )

    return run


def fit(whole: DataFrame, dims: int, codes: Codes = Codes(), id: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Codebooks (position, entry, component) of the integer vectors of `scaled`."""
    width = dims // codes.parts
    start = whole.where(F.col(f"`{id}`").isNotNull()).orderBy(f"`{id}`", f"`{vector}`").limit(codes.entries).select(F.col(f"`{vector}`").alias("v")).collect()
    books = np.array([r.v for r in start], np.int64).reshape(len(start), codes.parts, width).transpose(1, 0, 2).copy()
    if not len(start):
        return books
    parts = pin(_distinct_parts(whole, dims, codes, vector))
    schema = "position int, entry int, weight bigint, total array<bigint>"
    # Sums are exact decimals, so that many large components do not overflow.
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    for _ in range(codes.rounds):
        sums = parts.mapInArrow(_sums(books), schema).groupBy("position", "entry").agg(F.sum("weight").alias("weight"), *exact)
        for r in sums.collect():
            books[r.position, r.entry] = [int(r[f"t{i}"]) // r.weight for i in range(width)]
    return books


def encode(whole: DataFrame, books: np.ndarray, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """Add the code (two hex digits a part) and the squared distance to the integer vectors."""
    n_parts, _, width = books.shape
    kept = [c for c in whole.columns if c.lower() not in (code.lower(), error.lower())]
    place = kept.index(vector)
    carried = whole.select(*[F.col(f"`{c}`") for c in kept])
    out = carried.withColumn(code, F.lit("")).withColumn(error, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                rows = _matrix(some.column(place), n_parts * width)
                found, far = np.zeros((len(rows), n_parts), np.uint8), np.zeros(len(rows), np.int64)
                for k in range(n_parts):
                    part = rows[:, k * width : (k + 1) * width]
                    order = np.lexsort(part.T[::-1])
                    entry, distance, _ = Trie(books[k]).leaves(part[order])
                    found[order, k] = entry
                    far[order] += distance
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([r.tobytes().hex() for r in found]), pa.array(far)], [*kept, code, error])

    return carried.mapInArrow(run, out)


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(str(x) for x in books.reshape(-1))


def compress(vectors: DataFrame, codes: Codes = Codes(), id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """The usable rows with code and error, and the codebooks."""
    dims = dimensions(vectors, codes, id, vector)
    whole = scaled(vectors, dims, codes, vector)
    books = fit(whole, dims, codes, id, vector) if dims else np.zeros((codes.parts, 0, 0), np.int64)
    if not books.size:
        # No row has both an id and a usable vector, so there is nothing to compare with.
        return whole.where("false").withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint")}), books
    return encode(whole, books, vector), books


def _null_safe(name: str) -> Column:
    return F.struct(F.col(f"`{name}`").isNull().alias("none"), F.col(f"`{name}`").alias("value"))


def report(vectors: DataFrame, codes: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row."""
    coded, books = compress(vectors, codes)
    rows = pin(coded.select("vec_id", "code", "error", _null_safe("label").alias("l")))
    of_label = pin(rows.groupBy("l").agg(F.try_sum("error").alias("label_error")))
    digest = F.sha2(F.lit(books_text(books)), 256)
    return dim_join(rows, of_label, ["l"], spread_by="vec_id").select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _oracle(codes: Codes = Codes()) -> str:
    """DuckDB counterpart of `report` for vectors of one length."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(cast(x AS double) * {codes.scale})::bigint) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0)""",
        f"""parts AS MATERIALIZED (
  SELECT r, vec_id, i AS p, v[i * (len(v) // {codes.parts}) + 1 : (i + 1) * (len(v) // {codes.parts})] AS part
  FROM kept, range({codes.parts}) AS t(i))""",
        f"""book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS b FROM parts
  WHERE r IN (SELECT r FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {codes.entries}))""",
    ]
    for k in range(codes.rounds + 1):
        far = "list_sum(list_transform(list_zip(part, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, part, min(struct_pack(d := d, e := e)) AS m FROM (SELECT r, parts.p, part, e, {far} AS d FROM parts JOIN book{k} ON parts.p = book{k}.p)
  GROUP BY r, p, part)""")
        if k < codes.rounds:
            steps.append(f"""sums{k} AS MATERIALIZED (
  SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS b FROM (
    SELECT p, m.e AS e, j, sum(part[j])::bigint AS s, count(*) AS c
    FROM near{k}, range(1, (SELECT max(len(part)) + 1 FROM parts)) AS t(j) GROUP BY ALL)
  GROUP BY p, e)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT book{k}.p, book{k}.e, coalesce(sums{k}.b, book{k}.b) AS b FROM book{k} LEFT JOIN sums{k} ON book{k}.p = sums{k}.p AND book{k}.e = sums{k}.e)""")
    last = codes.rounds
    return "WITH " + ",\n".join(steps) + f""",
coded AS MATERIALIZED (
  SELECT r, string_agg(printf('%02x', m.e::bigint), '' ORDER BY p) AS code, sum(m.d)::bigint AS error FROM near{last} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM coded JOIN kept ON coded.r = kept.r, digest"""


ORACLE = _oracle()
