"""Two rounds of questions between chunks of documents and buckets of keys.

Documents are dealt to chunks by a hash of their id. In each round every chunk sends, to each
bucket, the sorted distinct keys it has there; a bucket sees the keys of all chunks and answers
every chunk separately. A key that a third of all documents hold is thus one entry per chunk.
Keys travel as compressed arrays instead of rows, a few bytes each. The numbers of chunks and buckets
grow with the texts, and with their product what every pair of them costs; so neighbouring chunks make
a box, whose keys for a bucket are one row. A task holds one box's texts and keys, of which it examines
one chunk at a time, or one bucket's keys.

The documents' shuffle is written once and read by all three passes; nothing is kept on one
executor only, and every pass can be recomputed: answers refer to the sorted order of a chunk's
keys, which does not depend on the order in which rows arrive.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import SLICE_BYTES, slices, text_bytes

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 2 << 20
# Chunks of a box at most, and boxes for every core at least.
BOX_CHUNKS = 8
CORE_BOXES = 8

# Arrays that hold less than this together are compressed as one.
JOINED_BYTES = 8 << 10

_codec = pa.Codec("zstd", 1)
_HEAD = struct.Struct("<c?Bq")
Arrays = list[np.ndarray]
Key = tuple[pa.Scalar, ...]


def pack(arrays: Arrays) -> bytes:
    """Arrays as bytes; mostly sorted integers are kept as differences, all of them in byte planes.

    The more chunks and buckets there are, the shorter the arrays: short ones are compressed together.
    """
    heads, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        n, width = len(a), a.dtype.itemsize
        # Differences wrap, so a few falls, as between chunks, do no harm.
        rising = a.dtype.kind == "u" and width > 1 and n > 1 and 8 * np.count_nonzero(a[1:] < a[:-1]) <= n
        if rising:
            held = a.copy()
            held[1:] -= a[:-1]
        else:
            held = a
        planes.append(held.tobytes() if width == 1 else held.view(np.uint8).reshape(n, width).T.tobytes())
        heads.append(_HEAD.pack(a.dtype.kind.encode(), rising, width, n))
    if sum(map(len, planes)) < JOINED_BYTES:
        planes = [b"".join(planes)]
    bodies = [_codec.compress(p, asbytes=True) if p else b"" for p in planes]
    sizes = struct.pack(f"<{len(bodies)}q", *map(len, bodies))
    return b"".join((struct.pack("<HH", len(arrays), len(bodies)), *heads, sizes, *bodies))


def unpack(raw: bytes) -> Arrays:
    count, parts = struct.unpack_from("<HH", raw)
    heads = [_HEAD.unpack_from(raw, 4 + i * _HEAD.size) for i in range(count)]
    at = 4 + count * _HEAD.size
    sizes = struct.unpack_from(f"<{parts}q", raw, at)
    at += 8 * parts
    lengths = [width * n for _, _, width, n in heads]
    planes = []
    for size, whole in zip(sizes, lengths if parts == count and parts != 1 else [sum(lengths)]):
        planes.append(_codec.decompress(raw[at : at + size], whole, asbytes=True) if whole else b"")
        at += size
    held, arrays, at = b"".join(planes), [], 0
    for kind, rising, width, n in heads:
        a = np.frombuffer(held, np.uint8, width * n, at).reshape(width, n).T.copy().view(f"{kind.decode()}{width}").reshape(n)
        arrays.append(np.cumsum(a, dtype=a.dtype) if rising else a)
        at += width * n
    return arrays


# Arrays by place in a box; chunks without any are left out.
Parts = dict[int, Arrays]


def pack_parts(parts: Parts) -> bytes:
    """The arrays of several chunks behind one another, with their places and lengths."""
    lengths = [len(a) for arrays in parts.values() for a in arrays]
    joined = [np.concatenate(arrays) for arrays in zip(*parts.values())] if len(parts) > 1 else next(iter(parts.values()))
    return pack([np.array(list(parts), np.uint8), np.array(lengths, np.uint32), *joined])


def unpack_parts(raw: bytes) -> Parts:
    places, lengths, *joined = unpack(raw)
    ends = np.cumsum(lengths.reshape(len(places), len(joined)), axis=0, dtype=np.int64)
    begins = (ends - lengths.reshape(ends.shape)).tolist()
    return {at: [a[x:y] for a, x, y in zip(joined, b, e)] for at, b, e in zip(places.tolist(), begins, ends.tolist())}


@dataclass
class Texts:
    """One chunk's documents. Ids are numbers; rows without an id are marked as absent."""

    ids: np.ndarray
    present: np.ndarray
    column: pa.Array

    def slices(self, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        return slices(self.column, limit)


# Arrays by bucket.
Sent = dict[int, Arrays]


class Method(Protocol):
    """What is asked and answered. `buckets` is the number of buckets in both rounds."""

    def ask(self, texts: Texts, buckets: int) -> Sent: ...

    def meet(self, bucket: int, asked: list[Arrays]) -> list[Arrays]:
        """An answer to each chunk's arrays, in the same order."""

    def ask_again(self, texts: Texts, buckets: int, first: Sent) -> Sent: ...

    def settle(self, bucket: int, asked: list[Arrays]) -> list[Arrays]: ...

    def finish(self, texts: Texts, buckets: int, first: Sent, second: Sent) -> pa.Table: ...


_ROWS = "bucket int, box int, round int, payload binary"


def _rows(sent: dict[int, Parts], box: int, turn: int) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array(list(sent), pa.int32()),
            "box": pa.array([box] * len(sent), pa.int32()),
            "round": pa.array([turn] * len(sent), pa.int32()),
            "payload": pa.array([pack_parts(p) for p in sent.values()], pa.binary()),
        }
    )


def _texts(rows: pa.Table) -> Texts:
    ids, column = rows["doc_id"].combine_chunks(), rows["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    present = ids.is_valid().to_numpy(zero_copy_only=False)
    return Texts(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), present, column)


def _chunks(rows: pa.Table, size: int) -> Iterator[tuple[int, Texts]]:
    """Place and texts of each chunk of a box."""
    numbers = rows["chunk"].to_numpy()
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(numbers[order[a]]) % size, _texts(rows if len(cuts) == 1 else rows.take(order[a:b]))


def _answers(rows: pa.Table, turn: int) -> dict[int, Sent]:
    """What the buckets answered, by place of the chunk."""
    answers: dict[int, Sent] = {}
    for b, r, p in zip(rows["bucket"].to_pylist(), rows["round"].to_pylist(), rows["payload"].to_pylist()):
        for at, arrays in unpack_parts(p).items() if r == turn else ():
            answers.setdefault(at, {})[b] = arrays
    return answers


def two_rounds(docs: DataFrame, method: Method, schema: str) -> DataFrame:
    """Run a method over all rows of docs (doc_id, text)."""
    spark = docs.sparkSession
    total, width = text_bytes(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # At least a few for every core; beyond that they only depend on the texts.
    cores = spark.sparkContext.defaultParallelism
    chunks = max(cores, -(-total // CHUNK_BYTES))
    buckets = max(cores, -(-total // BUCKET_BYTES))
    size = min(BOX_CHUNKS, max(1, chunks // (CORE_BOXES * cores)))

    chunk = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(chunks)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("chunk", chunk)
    dealt = dealt.withColumn("box", F.floor(F.col("chunk") / size).cast("int")).repartition(width, "box")

    def sent_by(rows: pa.Table, box: int, turn: int, asks) -> pa.Table:
        sent: dict[int, Parts] = {}
        for at, texts in _chunks(rows, size):
            for bucket, arrays in asks(at, texts).items():
                sent.setdefault(bucket, {})[at] = arrays
        return _rows(sent, box, turn)

    def ask(key: Key, rows: pa.Table) -> pa.Table:
        return sent_by(rows, key[0].as_py(), 1, lambda at, texts: method.ask(texts, buckets))

    def answer(turn: int):
        def run(key: Key, rows: pa.Table) -> pa.Table:
            # Boxes in a fixed order, so that recomputed answers are the same.
            order = np.argsort(rows["box"].to_numpy(), kind="stable")
            boxes = rows["box"].to_numpy()[order].tolist()
            payloads = rows["payload"].to_pylist()
            parts = [unpack_parts(payloads[i]) for i in order]
            del payloads
            bucket = key[0].as_py()
            asked = [arrays for p in parts for arrays in p.values()]
            made = iter((method.meet if turn == 1 else method.settle)(bucket, asked))
            tables = [_rows({}, 0, turn)]
            for box, p in zip(boxes, parts):
                answered = {at: a for at, a in zip(p, made) if any(map(len, a))}
                if answered:
                    tables.append(_rows({bucket: answered}, box, turn))
            return pa.concat_tables(tables)

        return run

    def ask_again(key: Key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows({}, 0, 2)
        first = _answers(answers, 1)
        return sent_by(rows, rows["box"][0].as_py(), 2, lambda at, texts: method.ask_again(texts, buckets, first.get(at, {})))

    def finish(key: Key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        first, second = _answers(answers, 1), _answers(answers, 2)
        return pa.concat_tables(
            method.finish(texts, buckets, first.pop(at, {}), second.pop(at, {})) for at, texts in _chunks(rows, size)
        )

    asked = dealt.groupBy("box").applyInArrow(ask, _ROWS)
    first = asked.groupBy("bucket").applyInArrow(answer(1), _ROWS).repartition(width, "box")
    again = dealt.groupBy("box").cogroup(first.groupBy("box")).applyInArrow(ask_again, _ROWS)
    second = again.groupBy("bucket").applyInArrow(answer(2), _ROWS).repartition(width, "box")
    return dealt.groupBy("box").cogroup(first.unionByName(second).groupBy("box")).applyInArrow(finish, schema)


def split_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 32 bits, the key's upper 32 bits in the lower."""
    bucket = ((keys & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (keys >> np.uint64(32))


def by_bucket(sorted_keys: np.ndarray, *more: np.ndarray) -> Sent:
    """Cut sorted results of `split_keys`, and arrays beside them, into buckets."""
    numbers = (sorted_keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(numbers, prepend=-1))
    ends = np.r_[cuts[1:], len(numbers)]
    low = sorted_keys.astype(np.uint32)
    return {int(numbers[a]): [low[a:b], *[m[a:b] for m in more]] for a, b in zip(cuts, ends)}


def whole_keys(sent: Sent) -> np.ndarray:
    """The sorted results of `split_keys` whose lower halves are the first arrays of `sent`."""
    parts = [(np.uint64(b) << np.uint64(32)) | sent[b][0].astype(np.uint64) for b in sorted(sent)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each key in sorted `known`, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)
