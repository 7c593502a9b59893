"""Substring dedup on words: fixed blocks as anchors, probed with every rolling window.

A run of `window` words of a document is deleted where the same run also starts in a document
with a smaller id. Blocks of (window + 1) / 2 words at every multiple of that length are indexed
for every document; any run of `window` words holds a whole block, wherever it starts. All
rolling windows of the block's length probe the index. Around each hit, on the side of the block
and on that of the probe, the hit is extended: all runs of `window` words that contain it are
compared, by a 64-bit hash and the bits that choose the bucket, and the smallest document that
has a run keeps it. Adjoining deleted runs join to maximal ones.

The first comparison only needs to know that a key has a block and occurs in two documents, and
uses 32 bits beside the bucket; its few false hits end in the second.

Null or empty texts have no words. Rows with one id never delete from each other. A row without
an id neither deletes nor loses words. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyweave.llm.common import BYTE_VALUES, SPACE, covered, runs, span_hashes, windows
from tallyweave.llm.exchange import Arrays, Sent, Texts, among, by_bucket, split_keys, two_rounds, whole_keys

WINDOW = 13


class _Words:
    """Word hashes of a chunk, all slices together, and the first word of every row."""

    def __init__(self, texts: Texts, kinds: int):
        hashes, counts = [[] for _ in range(kinds)], []
        for _, _, data, offsets in texts.slices():
            starts, ends, bounds = runs(~SPACE[data], offsets)
            for kind in range(kinds):
                hashes[kind].append(span_hashes(BYTE_VALUES[kind][data], starts, ends))
            counts.append(np.diff(bounds))
        self.hashes = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.bounds = np.r_[0, np.cumsum(self.counts)].astype(np.int64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return windows(self.hashes[0], self.bounds, k)


class _BlockAnchors:
    def __init__(self, window: int):
        self.window, self.block = window, (window + 1) // 2

    def _probes(self, texts: Texts, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, rows = words.windows(self.block)
        there = texts.present[rows]
        at, rows = at[there], rows[there]
        return at, rows, span_hashes(words.hashes[0], at, at + self.block)

    def ask(self, texts: Texts, buckets: int) -> Sent:
        words = _Words(texts, 1)
        at, rows, hashes = self._probes(texts, words)
        keys = split_keys(hashes, buckets)
        order = np.argsort(keys, kind="stable")
        keys, rows, at = keys[order], rows[order], at[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        if not len(first):
            return {}
        block = (at - words.bounds[rows]) % self.block == 0
        several = np.minimum.reduceat(rows, first) != np.maximum.reduceat(rows, first)
        flags = np.logical_or.reduceat(block, first).astype(np.uint8) | (several.astype(np.uint8) << 1)
        return by_bucket(keys[first], flags)

    def meet(self, bucket: int, asked: list[Arrays]) -> list[Arrays]:
        keys, flags = (np.concatenate([a[i] for a in asked]) for i in (0, 1))
        owner = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
        order = np.argsort(keys, kind="stable")
        keys, flags, owner = keys[order], flags[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[first, len(keys)])
        joined = np.bitwise_or.reduceat(flags, first)
        hit = np.repeat(((joined & 1) > 0) & ((counts > 1) | ((joined & 2) > 0)), counts)
        keys, owner = keys[hit], owner[hit]
        order = np.argsort(owner, kind="stable")
        keys, cuts = keys[order], np.searchsorted(owner[order], np.arange(len(asked) + 1))
        return [[keys[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _extended(self, texts: Texts, buckets: int, first: Sent):
        """Runs of `window` words around hits: starts, rows, and the distinct runs with their least ids."""
        words = _Words(texts, 2)
        at, _, hashes = self._probes(texts, words)
        hit = np.zeros(len(words.hashes[0]) + 1, np.int64)
        hit[at[among(split_keys(hashes, buckets), whole_keys(first)) >= 0]] = 1
        before = np.r_[0, np.cumsum(hit)]
        starts, rows = words.windows(self.window)
        inside = self.window - self.block + 1
        near = before[np.minimum(starts + inside, len(before) - 1)] > before[starts]
        near &= texts.present[rows]
        starts, rows = starts[near], rows[near]
        a, b = (span_hashes(h, starts, starts + self.window) for h in words.hashes)
        bucket = (split_keys(b, buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((texts.ids[rows], a, bucket))
        starts, rows, a, bucket = starts[order], rows[order], a[order], bucket[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1])
        return words, starts, rows, a, bucket, fresh

    def ask_again(self, texts: Texts, buckets: int, first: Sent) -> Sent:
        _, _, rows, a, bucket, fresh = self._extended(texts, buckets, first)
        a, bucket, least = a[fresh], bucket[fresh], texts.ids[rows[fresh]]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return {int(bucket[i]): [a[i:j], least[i:j]] for i, j in zip(cuts, np.r_[cuts[1:], len(a)])}

    def settle(self, bucket: int, asked: list[Arrays]) -> list[Arrays]:
        keys, ids = (np.concatenate([a[i] for a in asked]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.r_[first, len(keys)]))
        earlier = np.zeros(len(keys), bool)
        earlier[order] = least < ids[order]
        cuts = np.cumsum([0, *[len(a[0]) for a in asked]])
        # One bit per run, in the order in which the chunk sent them.
        return [[np.packbits(earlier[i:j])] for i, j in zip(cuts, cuts[1:])]

    def finish(self, texts: Texts, buckets: int, first: Sent, second: Sent) -> pa.Table:
        words, starts, rows, _, bucket, fresh = self._extended(texts, buckets, first)
        earlier = np.zeros(int(fresh.sum()), bool)
        numbers = bucket[fresh]
        cuts = np.flatnonzero(np.diff(numbers, prepend=-1))
        for i, j in zip(cuts, np.r_[cuts[1:], len(numbers)]):
            earlier[i:j] = np.unpackbits(second[int(numbers[i])][0], count=j - i)
        if len(fresh):
            which = np.cumsum(fresh) - 1
            least = texts.ids[rows[fresh]][which]
            gone = earlier[which] | (texts.ids[rows] > least)
            starts = starts[gone]
        deleted = covered(starts, self.window, len(words.hashes[0]))

        kept, spans = [], []
        for r, text in enumerate(texts.column):
            found = (text.as_py() or "").encode().split()
            out = deleted[words.bounds[r] : words.bounds[r + 1]]
            edges = np.flatnonzero(np.diff(np.r_[False, out, False])).reshape(-1, 2)
            for a, b in edges[::-1]:
                del found[a:b]
            kept.append(b" ".join(found).decode())
            spans.append(edges.tolist())
        sums = np.r_[0, np.cumsum(deleted)]
        return pa.table(
            {
                "doc_id": pa.array(texts.ids, mask=~texts.present),
                "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array((sums[words.bounds[1:]] - sums[words.bounds[:-1]]).astype(np.int64)),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "kept": pa.array(kept, pa.string()),
            }
        )


def delete_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans (deleted runs of words), kept (left words) of every row."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept string"
    return two_rounds(docs, _BlockAnchors(window), schema)
