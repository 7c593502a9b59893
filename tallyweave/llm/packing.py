"""Packing: token sequences filled first-fit decreasing, in randomised groups of documents.

A document's ids, followed by the end id, are cut into full sequences and one rest. All pieces
are dealt to groups by a hash, and every group is packed on its own: pieces by falling length,
each into the first sequence with room, found by a tournament tree over the sequences' free
room. Groups have a bounded number of pieces whatever the table's size, so the result does not
depend on partitions, and groups large enough that little stays empty.

Ids are those of the named tokenizer file. Its byte-level merges are applied by a second library
reading the same vocabulary where that is known to give the same ids (texts of Latin letters),
because it is several times as fast; other texts go through the tokenizer itself.

Null or empty texts are one piece holding the end id. Repeated rows are packed each. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import slices
from tallyweave.session import pin

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
# Bytes up to this one start characters below U+0250 (or continue any).
_LATIN_LEAD = 0xC9


class Encoder:
    """Ids of texts, as the tokenizer file gives them without special tokens."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.marks = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def __call__(self, text: str, latin: bool) -> list[int]:
        if self.fast and latin and not any(mark in text for mark in self.marks):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def public_encoder() -> Encoder:
    """The public byte-level vocabulary installed with the tokenizer files."""
    import public_tokenizers as files

    return Encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def _piece_batches(encoder, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                made = []
                for r in range(end - first):
                    raw = data[offsets[r] : offsets[r + 1]]
                    latin = not len(raw) or raw.max() <= _LATIN_LEAD
                    ids = np.array([*encode(raw.tobytes().decode(), latin), end_id], "<u4")
                    for start in range(0, len(ids), length):
                        piece = ids[start : start + length]
                        made.append((r + first, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                columns = [pa.array(c) for c in np.array(made, np.int64).T]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(columns[0]), *columns[1:]],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def pieces(docs: DataFrame, encoder=public_encoder, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return rows.mapInArrow(_piece_batches(encoder, length, end_id), schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece, pieces being given in falling order of length.

    The leaves of a complete binary tree are the sequences' free room, inner nodes the larger of
    their two. Going left wherever there is room enough reaches the first sequence that fits.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i], offset[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
    return where, offset


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        ids = group["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((group["start"].to_numpy(), ids, -lengths))
        where, offset = first_fit_decreasing(lengths[order], capacity)
        packed = group.take(pa.array(order))
        number = packed["grp"].to_numpy() * (1 << 32) + where
        out = packed.drop_columns(["grp"])
        return out.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return run


def pack(cut: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    cut = pin(cut)
    groups = max(1, round(cut.count() / group_pieces))
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(groups)).cast("bigint"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("grp").applyInArrow(_pack_group(length), schema)


def pack_documents(docs: DataFrame, encoder=public_encoder, length: int = LENGTH) -> DataFrame:
    return pack(pieces(docs, encoder, length), length)
