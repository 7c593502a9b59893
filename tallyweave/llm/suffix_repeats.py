"""Substring dedup on bytes: maximal repeats from the interval tree of an enhanced suffix array.

Every byte that lies in a string of `least` bytes which also starts in a document with a smaller
id is deleted. A string of that length names one of its own substrings, the one with the smallest
hash (its anchor); neighbouring strings with the same anchor form a region of less than twice
the length, and every string lies in exactly one. Equal strings thus have equal anchors, and
documents only need to meet by anchor.

Round one finds the anchors that occur in two documents. Round two sends the distinct regions of
those to the anchor's bucket, where the regions' suffixes are sorted and their common prefixes
computed. A stack scan over them yields the intervals of suffixes with a common prefix; those
whose left extensions differ are the maximal repeats, each with all its occurrences. A region of
a later document is deleted where a repeat has an occurrence in an earlier one. Repeats longer
than a region come together again from adjoining regions when a document's deleted runs are
joined.

Equal regions are one text with their smallest id, so a hot passage is sorted once. An anchor
with very many different surroundings (`HOT_REGIONS`) is split: its strings are sent one by one
to the buckets of their own hashes.

Null or empty texts have no bytes. Rows with one id never delete from each other. A row without
an id neither deletes nor loses bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import BYTE_VALUES, mix, rolling_sums, span_hashes
from tallyweave.llm.exchange import Arrays, Sent, Texts, among, by_bucket, split_keys, two_rounds, whole_keys

LEAST = 50
# Length of the substrings that can be anchors.
ANCHOR = 16
HOT_REGIONS = 2_000
# Suffixes sorted at a time: equal suffixes share an anchor, so anchors can be taken in turn.
SORTED_SUFFIXES = 100_000
_PLACE_BITS = np.uint64(20)
_SEGMENT = 1 << 20


@dataclass
class Regions:
    """Regions of a chunk; starts count from the first byte of the chunk."""

    base: np.ndarray
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    windows: np.ndarray
    anchors: np.ndarray
    hashes: np.ndarray


def _segments(texts: Texts, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Bytes of about a megabyte with row offsets; a longer text comes in overlapping parts."""
    at = 0
    for first, end, data, offsets in texts.slices(_SEGMENT):
        for shift in range(0, max(1, len(data) - least + 1), _SEGMENT - least + 1):
            part = data[shift : shift + _SEGMENT]
            cut = offsets if len(data) <= _SEGMENT else np.array([0, len(part)])
            yield first, part, cut, at + shift
        at += len(data)


def regions(texts: Texts, least: int = LEAST, k: int = ANCHOR) -> Regions:
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    parts, sizes = [], []
    for _, _, data, offsets in texts.slices():
        parts.append(data)
        sizes.append(np.diff(offsets))
    base = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64)
    span = least - k + 1
    for first, data, offsets, at in _segments(texts, least):
        n = len(data)
        if n < least:
            continue
        values = BYTE_VALUES[0][data]
        grams = rolling_sums(values, k)
        low = grams >> _PLACE_BITS
        low <<= _PLACE_BITS
        low |= np.arange(len(low), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: -(span - width)], low[span - width :])
        low &= (np.uint64(1) << _PLACE_BITS) - np.uint64(1)

        # Rows that hold a whole string, and where a new anchor begins among their strings.
        held = np.diff(offsets) >= least
        begin, end = offsets[:-1][held], offsets[1:][held] - least + 1
        inside = np.zeros(len(low) + 1, np.int8)
        inside[begin] += 1
        inside[end] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        fresh = np.ones(len(low), bool)
        fresh[1:] = low[1:] != low[:-1]
        fresh[begin] = True
        starts = np.flatnonzero(fresh & inside)
        if not len(starts):
            continue
        row = np.searchsorted(begin, starts, "right") - 1
        count = np.minimum(np.r_[starts[1:], len(low)], end[row]) - starts
        rows = np.flatnonzero(held)[row] + first
        gram = mix(grams[low[starts].astype(np.int64)])
        there = texts.present[rows]
        starts, count, rows, gram = starts[there], count[there], rows[there], gram[there]
        body = span_hashes(values, starts, starts + count + least - 1)
        for into, made in zip(found, (rows, starts + at, count, gram, body)):
            into.append(made)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    made = [np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, kinds)]
    return Regions(base, np.concatenate(parts) if parts else np.zeros(0, np.uint8), *made)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.uint8)
    shift = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return data[np.arange(total) + shift]


def common_prefix_intervals(lcp: list[int], lefts: list[int], ids: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of an enhanced suffix array: (first, last, length, smallest id).

    `lcp[i]` is the common prefix of suffixes i - 1 and i, `lefts[i]` the byte before suffix i (-1
    where the text begins). A stack holds the open intervals; one is closed when the common
    prefix falls below its length, and is a maximal repeat if its suffixes do not all have the
    same byte to the left.
    """
    found = []
    # Open intervals: common prefix, first suffix, left byte (-1: different ones), smallest id.
    lengths, firsts, sides, lows = [0], [0], [lefts[0] if lefts else -1], [ids[0] if ids else 0]
    for i in range(1, len(lcp) + 1):
        h = lcp[i] if i < len(lcp) else 0
        if h < least:
            h = 0
        first, side, low = i - 1, lefts[i - 1], ids[i - 1]
        while lengths[-1] > h:
            length, first = lengths.pop(), firsts.pop()
            own_side, own_low = sides.pop(), lows.pop()
            side = side if side == own_side else -1
            low = min(low, own_low)
            if side == -1:
                found.append((first, i - 1, length, low))
        if lengths[-1] < h:
            lengths.append(h)
            firsts.append(first)
            sides.append(side)
            lows.append(low)
        elif lengths[-1]:
            sides[-1] = side if side == sides[-1] else -1
            lows[-1] = min(low, lows[-1])
    return found


@dataclass
class Suffixes:
    """Sorted suffixes of several texts: the text and offset of each, and its common prefix."""

    text: np.ndarray
    offset: np.ndarray
    lcp: np.ndarray
    left: np.ndarray


def suffix_array(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> Suffixes:
    """Sort the suffixes of at least `least` bytes of texts lying in `data`."""
    counts = np.maximum(lengths - least + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    length, at = lengths[text] - offset, starts[text] + offset
    width = int(lengths.max(initial=1))
    padded = np.r_[data, np.zeros(width, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    rows = np.where(np.arange(width) < length[:, None], rows, np.uint8(0))
    # Equal but for their ends: the shorter first, as a prefix sorts.
    order = np.argsort(length, kind="stable")
    order = order[np.argsort(np.ascontiguousarray(rows[order]).view(f"S{width}").ravel(), kind="stable")]
    rows, length, text, offset, at = rows[order], length[order], text[order], offset[order], at[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.minimum(same, np.minimum(length[1:], length[:-1]))
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    return Suffixes(text, offset, lcp, left)


class _SuffixRepeats:
    def __init__(self, least: int, groups: bool = False, hot: int = HOT_REGIONS):
        self.least, self.groups, self.hot = least, groups, hot

    def ask(self, texts: Texts, buckets: int) -> Sent:
        own = regions(texts, self.least)
        keys = split_keys(own.anchors, buckets)
        order = np.lexsort((own.hashes, keys))
        keys, rows, hashes = keys[order], own.rows[order], own.hashes[order]
        if not len(keys):
            return {}
        fresh = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(fresh)
        different = np.add.reduceat((fresh | np.r_[True, hashes[1:] != hashes[:-1]]).astype(np.int64), first)
        several = np.minimum.reduceat(rows, first) != np.maximum.reduceat(rows, first)
        return by_bucket(keys[first], different.astype(np.uint32), several.astype(np.uint8))

    def meet(self, bucket: int, asked: list[Arrays]) -> list[Arrays]:
        keys, different, several = (np.concatenate([a[i] for a in asked]) for i in range(3))
        owner = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
        order = np.argsort(keys, kind="stable")
        keys, different, several, owner = keys[order], different[order], several[order], owner[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[first, len(keys)])
        several = np.maximum.reduceat(several, first) > 0
        # Regions that several chunks have count in each, so the sum is never below the true number.
        hot = np.add.reduceat(different.astype(np.int64), first) > self.hot
        hit, hot = np.repeat((counts > 1) | several, counts), np.repeat(hot, counts)
        keys, owner, hot = keys[hit], owner[hit], hot[hit]
        order = np.argsort(owner, kind="stable")
        keys, hot, cuts = keys[order], hot[order].astype(np.uint8), np.searchsorted(owner[order], np.arange(len(asked) + 1))
        return [[keys[a:b], hot[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _entries(self, texts: Texts, buckets: int, first: Sent):
        """Distinct regions of shared anchors, and distinct strings of hot ones, by bucket.

        For each of the two: bucket, starts, lengths, ids and, for every occurrence in the chunk,
        its start, row and entry.
        """
        own = regions(texts, self.least)
        keys = split_keys(own.anchors, buckets)
        at = among(keys, whole_keys(first))
        hot_keys = np.concatenate([first[b][1] for b in sorted(first)]) if first else np.zeros(0, np.uint8)
        hot = (hot_keys[at] > 0) & (at >= 0) if len(hot_keys) else np.zeros(len(keys), bool)
        plain = (at >= 0) & ~hot

        def distinct(bucket, more, starts, lengths, rows):
            order = np.lexsort((texts.ids[rows], *more[::-1], bucket))
            fresh = np.ones(len(order), bool)
            if len(order):
                fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in (bucket, *more)], axis=0)
            lead = order[fresh]
            entry = np.cumsum(fresh) - 1
            return bucket[lead], [m[lead] for m in more], starts[lead], lengths[lead], texts.ids[rows[lead]], (starts[order], rows[order], lengths[order], entry)

        p = np.flatnonzero(plain)
        one = distinct(
            (keys[p] >> np.uint64(32)).astype(np.int64), [keys[p].astype(np.uint32), own.hashes[p], own.windows[p]],
            own.starts[p], own.windows[p] + self.least - 1, own.rows[p],
        )
        h = np.flatnonzero(hot)
        each = np.repeat(h, own.windows[h])
        starts = own.starts[each] + np.arange(len(each)) - np.repeat(np.cumsum(own.windows[h]) - own.windows[h], own.windows[h])
        rows = own.rows[each]
        # Hashes of strings lying anywhere in the chunk, without prefix sums over all of it.
        text = self._string_hashes(own.data, starts)
        bucket = (split_keys(mix(text), buckets) >> np.uint64(32)).astype(np.int64)
        two = distinct(bucket, [text], starts, np.full(len(starts), self.least), rows)
        return own, one, two

    def _string_hashes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        made = [np.zeros(0, np.uint64)]
        for i in range(0, len(starts), 1 << 14):
            part = starts[i : i + (1 << 14)]
            held = _gather(data, part, np.full(len(part), self.least))
            begin = np.arange(len(part)) * self.least
            made.append(span_hashes(BYTE_VALUES[0][held], begin, begin + self.least))
        return np.concatenate(made)

    def ask_again(self, texts: Texts, buckets: int, first: Sent) -> Sent:
        own, one, two = self._entries(texts, buckets, first)
        sent: Sent = {}
        empty = [np.zeros(0, t) for t in (np.uint32, np.uint8, np.int64, np.uint8, np.int64, np.uint8)]
        for which, (bucket, more, starts, lengths, ids, _) in enumerate((one, two)):
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
                into = sent.setdefault(int(bucket[a]), list(empty))
                held = _gather(own.data, starts[a:b], lengths[a:b])
                if which:
                    into[4:] = [ids[a:b], held]
                else:
                    into[:4] = [more[0][a:b], (lengths[a:b] - self.least + 1).astype(np.uint8), ids[a:b], held]
        return sent

    def settle(self, bucket: int, asked: list[Arrays]) -> list[Arrays]:
        anchors, windows, ids, data, hot_ids, hot_data = (np.concatenate([a[i] for a in asked]) for i in range(6))
        lengths = windows.astype(np.int64) + self.least - 1
        starts = np.cumsum(lengths) - lengths
        marks, groups = self._settle_regions(bucket, anchors, lengths, ids, starts, data)
        hot_starts = np.arange(len(hot_ids)) * self.least
        same, low = self._same(hot_data, hot_starts, np.full(len(hot_ids), self.least), hot_ids)
        hot_marks = (hot_ids > low[same]).astype(np.uint8) if len(hot_ids) else np.zeros(0, np.uint8)
        if self.groups:
            # A hot string is a repeat of its own.
            names = mix(self._string_hashes(hot_data, hot_starts))
        cuts, hot_cuts = (np.cumsum([0, *[len(a[i]) for a in asked]]) for i in (2, 4))
        answers = []
        for i in range(len(asked)):
            a, b, c, d = cuts[i], cuts[i + 1], hot_cuts[i], hot_cuts[i + 1]
            answer = [marks[a:b], hot_marks[c:d]]
            if self.groups:
                mine = (groups[0] >= a) & (groups[0] < b)
                answer += [groups[0][mine] - a, *[g[mine] for g in groups[1:]], names[c:d]]
            answers.append(answer)
        return answers

    def _same(self, data, starts, lengths, ids) -> tuple[np.ndarray, np.ndarray]:
        """Number of each text's class of equal texts, and the smallest id of every class."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = [self._hash_parts(v, data, starts, lengths) for v in BYTE_VALUES]
        order = np.lexsort((ids, lengths, *hashes))
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([h[order][1:] != h[order][:-1] for h in (*hashes, lengths)], axis=0)
        same = np.empty(len(order), np.int64)
        same[order] = np.cumsum(fresh) - 1
        return same, ids[order[fresh]]

    def _hash_parts(self, values, data, starts, lengths) -> np.ndarray:
        made, i = [], 0
        ends = starts + lengths
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
            a, b = starts[i], ends[j - 1]
            made.append(span_hashes(values[data[a:b]], starts[i:j] - a, ends[i:j] - a))
            i = j
        return np.concatenate(made)

    def _settle_regions(self, bucket, anchors, lengths, ids, starts, data):
        """Deleted strings of every region, as bits, and the maximal repeats it takes part in."""
        n = len(starts)
        marks = np.zeros(n, np.uint64)
        nothing = tuple(np.zeros(0, t) for t in (np.int64, np.uint8, np.uint8, np.uint64))
        if not n:
            return marks, nothing
        same, low = self._same(data, starts, lengths, ids)
        lead = np.empty(len(low), np.int64)
        lead[same[::-1]] = np.arange(n)[::-1]
        full = (np.uint64(1) << (lengths - self.least + 1).astype(np.uint64)) - np.uint64(1)
        later = ids > low[same]
        marks[later] = full[later]
        groups = []
        if self.groups:
            # Equal regions are a repeat of their whole length.
            names = mix(self._hash_parts(BYTE_VALUES[1], data, starts, lengths))
            groups.append((np.arange(n), np.zeros(n, np.uint8), lengths.astype(np.uint8), names))

        # Suffixes of different regions can only agree within an anchor.
        order = np.argsort(anchors[lead], kind="stable")
        texts = lead[order]
        cuts = np.flatnonzero(np.r_[True, np.diff(anchors[texts].astype(np.int64)) != 0])
        sizes = np.diff(np.r_[cuts, len(texts)])
        some = np.repeat(sizes > 1, sizes)
        texts, first_of = texts[some], np.repeat(cuts, sizes)[some]
        held = np.cumsum(lengths[texts] - self.least + 1)
        done = 0
        class_marks = np.zeros(len(low), np.uint64)
        while done < len(texts):
            end = int(np.searchsorted(held, (held[done - 1] if done else 0) + SORTED_SUFFIXES)) + 1
            while end < len(texts) and first_of[end] == first_of[end - 1]:
                end += 1
            part = texts[done:end]
            found = suffix_array(data, starts[part], lengths[part], self.least)
            owner = same[part][found.text]
            repeats = common_prefix_intervals(found.lcp.tolist(), found.left.tolist(), low[owner].tolist(), self.least)
            if repeats:
                a, b, length, least_id = np.array(repeats, np.int64).T
                which = np.repeat(np.arange(len(a)), b - a + 1)
                member = np.arange(len(which)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[which]
                gone = low[owner[member]] > least_id[which]
                m, w = member[gone], which[gone]
                span = (np.uint64(1) << (length[w] - self.least + 1).astype(np.uint64)) - np.uint64(1)
                np.bitwise_or.at(class_marks, owner[m], span << found.offset[m].astype(np.uint64))
                if self.groups:
                    groups.append(self._members(bucket, repeats, found, part, same, which, member, length, data, starts))
            done = end
        marks |= class_marks[same] * (~later).astype(np.uint64)
        marks |= np.where(later, full, np.uint64(0))
        if not groups:
            return marks, nothing
        return marks, tuple(np.concatenate([g[i] for g in groups]) for i in range(4))

    def _members(self, bucket, repeats, found, part, same, which, member, length, data, starts):
        """Every region that holds an occurrence of a repeat: region, offset, length, repeat."""
        heads = np.array([r[0] for r in repeats])
        begin = starts[part][found.text[heads]] + found.offset[heads]
        order = np.argsort(begin, kind="stable")
        names = np.empty(len(heads), np.uint64)
        names[order] = [mix(span_hashes(BYTE_VALUES[1][data[x : x + y]], np.array([0]), np.array([y])))[0] for x, y in zip(begin[order], length[order])]
        classes = same[part][found.text[member]]
        by_class = np.argsort(same, kind="stable")
        low, high = np.searchsorted(same[by_class], classes), np.searchsorted(same[by_class], classes, "right")
        each = np.repeat(np.arange(len(member)), high - low)
        place = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
        return by_class[place], found.offset[member][each].astype(np.uint8), length[which][each].astype(np.uint8), names[which][each]

    def _answers(self, entries, second: Sent, place: int, kind) -> np.ndarray:
        bucket = entries[0]
        made = np.zeros(len(bucket), kind)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
            if int(bucket[a]) in second:
                made[a:b] = second[int(bucket[a])][place]
        return made

    def finish(self, texts: Texts, buckets: int, first: Sent, second: Sent) -> pa.Table:
        own, one, two = self._entries(texts, buckets, first)
        if self.groups:
            return self._occurrences(texts, one, two, second)
        change = np.zeros(len(own.data) + 1, np.int64)
        starts, rows, lengths, entry = one[5]
        later = texts.ids[rows] > one[4][entry] if len(entry) else np.zeros(0, bool)
        np.add.at(change, starts[later], 1)
        np.add.at(change, (starts + lengths)[later], -1)
        marks = self._answers(one, second, 0, np.uint64)
        rest = np.flatnonzero(~later & (marks[entry] > 0)) if len(entry) else np.zeros(0, np.int64)
        for w in range(self.least):
            hit = rest[(marks[entry[rest]] >> np.uint64(w)) & np.uint64(1) > 0]
            np.add.at(change, starts[hit] + w, 1)
            np.add.at(change, starts[hit] + w + self.least, -1)
        starts, rows, _, entry = two[5]
        if len(entry):
            gone = (texts.ids[rows] > two[4][entry]) | (self._answers(two, second, 1, np.uint8)[entry] > 0)
            np.add.at(change, starts[gone], 1)
            np.add.at(change, starts[gone] + self.least, -1)
        deleted = np.cumsum(change[:-1]) > 0

        removed, spans, kept = [], [], []
        for a, b in zip(own.base, own.base[1:]):
            out = deleted[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, out, False])).reshape(-1, 2)
            removed.append(int(out.sum()))
            spans.append(edges.tolist())
            kept.append(own.data[a:b][~out].tobytes() if len(edges) else own.data[a:b].tobytes())
        return pa.table(
            {
                "doc_id": pa.array(texts.ids, mask=~texts.present),
                "n_bytes": pa.array(np.diff(own.base).astype(np.int64)),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    def _occurrences(self, texts: Texts, one, two, second: Sent) -> pa.Table:
        made: list[list[np.ndarray]] = []
        base = np.r_[0, np.cumsum([len((t.as_py() or "").encode()) for t in texts.column])]
        starts, rows, lengths, entry = one[5]
        bucket = one[0]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        low, high = np.searchsorted(entry, np.arange(len(bucket))), np.searchsorted(entry, np.arange(len(bucket)), "right")
        for a in cuts:
            if int(bucket[a]) not in second:
                continue
            region, offset, length, name = second[int(bucket[a])][2:6]
            region = region + a
            count = high[region] - low[region]
            each = np.repeat(np.arange(len(region)), count)
            place = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + low[region][each]
            made.append([name[each], length[each].astype(np.int64), rows[place], starts[place] + offset[each]])
        starts, rows, _, entry = two[5]
        bucket = two[0]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        names = np.zeros(len(bucket), np.uint64)
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)]):
            if int(bucket[a]) in second:
                names[a:b] = second[int(bucket[a])][6]
        made.append([names[entry], np.full(len(entry), self.least), rows, starts])
        name, length, rows, starts = (np.concatenate([m[i] for m in made]) for i in range(4))
        return pa.table(
            {
                "repeat": pa.array(name.astype(np.uint64).view(np.int64)),
                "length": pa.array(length.astype(np.int64)),
                "doc_id": pa.array(texts.ids[rows]),
                "start": pa.array((starts - base[rows]).astype(np.int64)),
            }
        )


def delete_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal deleted runs), kept (left bytes) of every row."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    return two_rounds(docs, _SuffixRepeats(least), schema)


def repeat_groups(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """repeat, length, doc_id, start: the maximal repeats within regions, with all occurrences.

    Only repeats that occur in two documents are returned.
    """
    found = two_rounds(docs, _SuffixRepeats(least, groups=True), "repeat bigint, length bigint, doc_id bigint, start bigint")
    found = found.distinct()
    shared = found.groupBy("repeat", "length").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b")
    return found.join(shared.select("repeat", "length"), ["repeat", "length"])
