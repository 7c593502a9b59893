"""Spelling variants: the vocabulary acceptor composed with one edit and with itself.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code
point turns one into the other. Near words are the pairs that the machine A . E . A accepts,
where A is the minimised acceptor of the vocabulary and E copies its input but for one edit.
Until the edit both copies of A are in one state; behind it the machine is the intersection of
two right languages, so only pairs of states that still lead to a common end are followed. A's
arcs carry word counts, so a path through the machine ends with the ranks of the two words.

The vocabulary is cut into partitions by the state that a prefix leads to, and each is composed
in one task. A prefix with more than `limit` words is no partition: it is cut by its next code
point, again and again. The edits in the states above the partitions are found by a join: two
words that part at such a state are near if what follows the edit is equal. At most as many words
as the alphabet has code points, and one more, share such a key, so no group of it is large.
Words over `LONGEST` code points are too many levels for arrays; their near words are found by
hashes with one code point left out, and compared exactly.

A null text has no words; a null doc_id counts as an empty one where words are changed. Repeated
rows count each, ties of counts go to the smallest word. Empty tables give no rows. Other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import mix, seeded, settled
from tallyweave.operators.joins import dim_join
from tallyweave.session import pin

# Fixed values of the words: their letters, the lower-casing of A to Z, which occurrences lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
CHANGED = 31
TIMES = 10

# Words of one partition, and the mean of one task. A word takes some 4 KB while a task composes.
LIMIT = 16_000
LONGEST = 64
# Prefix lengths looked at in one round of cutting partitions.
LEVELS = 4


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n for every word of at least `min_length` code points and `min_count` occurrences."""
    # A run loses one code point at most, so shorter runs never make a word.
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))
    runs = docs.select("doc_id", F.explode(found).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(h % CHANGED == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= min_length) & (F.col("n") >= min_count))


# --- one partition -----------------------------------------------------------------------------


@dataclass
class Acceptor:
    """The minimal acceptor of sorted words, and the prefix tree it was made from.

    States are numbered by their right language. Arcs are sorted by (state, label); `skip` is the
    number of words of the state that come before those behind the arc.
    """

    accepting: np.ndarray  # by state
    size: np.ndarray  # words in the right language, by state
    first: np.ndarray  # first arc, by state, and one more
    label: np.ndarray
    to: np.ndarray
    skip: np.ndarray
    node_state: np.ndarray  # by node of the prefix tree
    node_word: np.ndarray  # first word below the node
    node_level: np.ndarray


_LABEL, _END = seeded(2, 71) | np.uint64(1)


def acceptor(symbols: np.ndarray, lengths: np.ndarray) -> Acceptor:
    """From a matrix of code points, one sorted word a row, filled up with zeros."""
    n, width = symbols.shape
    shared = np.zeros(n, np.int64)  # code points shared with the word before
    if n > 1:
        shared[1:] = np.argmax(symbols[1:] != symbols[:-1], 1)
    shared[0] = -1
    levels = []
    for level in range(int(lengths.max()) + 1):
        starts = np.flatnonzero((lengths >= level) & (shared < level))
        breaks = np.r_[np.flatnonzero(shared < level), n]
        ends = breaks[np.searchsorted(breaks, starts, "right")]
        levels.append((starts, ends))
    # Right languages as sums over arcs, from the longest words upwards.
    hashes: list[np.ndarray] = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    parents = []
    for level in range(len(levels) - 1, -1, -1):
        starts, _ = levels[level]
        own = np.where(lengths[starts] == level, _END, np.uint64(0))
        parent = np.zeros(0, np.int64)
        if below is not None and len(below[0]):
            child, child_hash = below
            parent = np.searchsorted(starts, child, "right") - 1
            cuts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            arcs = mix(child_hash * _LABEL + symbols[child, level].astype(np.uint64))
            own[parent[cuts]] += np.add.reduceat(arcs, cuts)
        own = mix(own)
        hashes.append(own)
        parents.append(parent)
        below = starts, own
    hashes.reverse()
    parents.reverse()
    counts = np.array([len(h) for h in hashes])
    base = np.r_[0, np.cumsum(counts)]
    starts, ends = (np.concatenate([x[i] for x in levels]) for i in (0, 1))
    node_level = np.repeat(np.arange(len(levels)), counts)
    _, example, state = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    # Every node but the root is the end of one arc; arcs of a state are those of its first node.
    child = np.arange(base[1], base[-1])
    parent = np.concatenate([p + base[k] for k, p in enumerate(parents)])
    kept = example[state[parent]] == parent
    child, parent = child[kept], parent[kept]
    source, label = state[parent], symbols[starts[child], node_level[child] - 1]
    order = np.lexsort((label, source))
    child, parent, source, label = child[order], parent[order], source[order], label[order]
    return Acceptor(
        lengths[starts[example]] == node_level[example],
        (ends - starts)[example],
        np.searchsorted(source, np.arange(len(example) + 1)),
        label.astype(np.int64),
        state[child],
        starts[child] - starts[parent],
        state,
        starts,
        node_level,
    )


def _spans(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position for runs of `counts` positions from `first`."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def _edits(a: Acceptor, states: np.ndarray):
    """The one-edit arcs of the machine at its states (s, s).

    Each leads to a pair of states: source state, the pair, words skipped on either side, and the
    label that the second side must not go on with (an equal one would move the edit further on).
    """
    degree = a.first[states + 1] - a.first[states]
    owner, arc = _spans(a.first[states], degree)
    # A code point of the first side that the second one does not have.
    gone = (states[owner], a.to[arc], states[owner], a.skip[arc], np.zeros(len(arc), np.int64), a.label[arc])
    # Two code points in one place: each arc with the later ones of its state.
    later = (a.first[states + 1][owner] - arc - 1)
    which, other = _spans(arc + 1, later)
    one = arc[which]
    changed = (states[owner][which], a.to[one], a.to[other], a.skip[one], a.skip[other], np.full(len(one), -1))
    return [np.concatenate(x) for x in zip(gone, changed)]


def _step(a: Acceptor, p: np.ndarray, q: np.ndarray, barred: np.ndarray | None = None):
    """Arcs of both states with one label: index of the pair, and the two arcs."""
    # The side with fewer arcs is followed, the other one looked up.
    less = (a.first[p + 1] - a.first[p]) <= (a.first[q + 1] - a.first[q])
    few, many = np.where(less, p, q), np.where(less, q, p)
    owner, arc = _spans(a.first[few], a.first[few + 1] - a.first[few])
    keys = (np.repeat(np.arange(len(a.first) - 1), np.diff(a.first)) << 21) + a.label
    wanted = (many[owner] << 21) + a.label[arc]
    place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    found = keys[place] == wanted if len(keys) else np.zeros(0, bool)
    if barred is not None:
        found &= a.label[arc] != barred[owner]
    owner, arc, place = owner[found], arc[found], place[found]
    return owner, np.where(less[owner], arc, place), np.where(less[owner], place, arc)


def near_ranks(symbols: np.ndarray, lengths: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are one edit apart and share at least `depth` code points of their start.

    Rows are sorted, distinct words; each unordered pair comes once.
    """
    a = acceptor(symbols, lengths)
    nodes = np.flatnonzero(a.node_level >= depth[a.node_word])
    states = np.unique(a.node_state[nodes])
    source, p, q, skip_p, skip_q, barred = _edits(a, states)

    # Forwards: all pairs of states behind an edit, level by level. A pair (s, s) accepts all of s.
    # Labels are below 2**21 and a task's states below 2**20.
    keys = ((p * len(a.size) + q) << 21) + barred + 1
    _, example, entry = np.unique(keys, return_index=True, return_inverse=True)
    layers, steps = [(p[example], q[example])], []
    bar = barred[example]
    while True:
        p1, q1 = layers[-1]
        on = np.flatnonzero(p1 != q1)
        owner, arc_p, arc_q = _step(a, p1[on], q1[on], None if bar is None else bar[on])
        bar = None
        pairs, target = np.unique(a.to[arc_p] * np.int64(len(a.size)) + a.to[arc_q], return_inverse=True)
        steps.append((on[owner], arc_p, arc_q, target))
        if not len(pairs):
            break
        layers.append((pairs // len(a.size), pairs % len(a.size)))

    # Backwards: which of them still lead to an end both sides have.
    live: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        p1, q1 = layers[k]
        useful = (a.accepting[p1] & a.accepting[q1]) | (p1 == q1)
        from_, arc_p, arc_q, target = steps[k]
        if len(target):
            leads = live[-1][target]
            steps[k] = from_[leads], arc_p[leads], arc_q[leads], target[leads]
            useful[from_[leads]] = True
        live.append(useful)
    live.reverse()

    # Enumerate: from every node of the prefix tree through its state's live edits to the ends.
    good = live[0][entry]
    source, entry, skip_p, skip_q = source[good], entry[good], skip_p[good], skip_q[good]
    order = np.argsort(source, kind="stable")
    source, entry, skip_p, skip_q = source[order], entry[order], skip_p[order], skip_q[order]
    begin = np.searchsorted(source, a.node_state[nodes])
    owner, edit = _spans(begin, np.searchsorted(source, a.node_state[nodes], "right") - begin)
    at, one, two = entry[edit], a.node_word[nodes][owner] + skip_p[edit], a.node_word[nodes][owner] + skip_q[edit]
    left, right = [], []
    for k, (p1, q1) in enumerate(layers):
        equal = p1[at] == q1[at]
        owner, nth = _spans(np.zeros(int(equal.sum()), np.int64), a.size[p1[at][equal]])
        left.append(one[equal][owner] + nth)
        right.append(two[equal][owner] + nth)
        both = ~equal & a.accepting[p1[at]] & a.accepting[q1[at]]
        left.append(one[both])
        right.append(two[both])
        from_, arc_p, arc_q, target = steps[k]
        order = np.argsort(from_, kind="stable")
        from_, arc_p, arc_q, target = from_[order], arc_p[order], arc_q[order], target[order]
        begin = np.searchsorted(from_, at)
        counts = np.searchsorted(from_, at, "right") - begin
        owner, way = _spans(begin, counts)
        one, two = one[owner] + a.skip[arc_p[way]], two[owner] + a.skip[arc_q[way]]
        at = target[way]
        if not len(at):
            break
    return np.concatenate(left), np.concatenate(right)


def _near_in_partition(rows: pa.Table) -> pa.Table:
    words = np.array(rows["word"].to_pylist(), dtype=f"<U{LONGEST}")
    order = np.argsort(words)
    words = words[order]
    symbols = words.view(np.uint32).reshape(len(words), -1)
    lengths = (symbols != 0).sum(1)
    one, two = near_ranks(symbols, lengths, rows["depth"].to_numpy()[order])
    n = rows["n"].to_numpy()[order]
    from_, to = np.r_[one, two], np.r_[two, one]
    names = pa.array(words.tolist(), pa.string())
    return pa.table({"word": names.take(pa.array(from_)), "near": names.take(pa.array(to)), "near_n": pa.array(n[to])})


# --- all partitions ----------------------------------------------------------------------------


def _placed(words: DataFrame, limit: int) -> DataFrame:
    """The words (of more than `limit`) with the length of their partition's prefix as `depth`.

    It is the shortest prefix that at most `limit` words have; a word that is itself a prefix of
    more words gets one more than its length and is in no partition.
    """
    parts, left, level = [], words, 0
    while True:
        keyed = left.withColumn("k", F.explode(F.sequence(F.lit(level + 1), F.lit(level + LEVELS))))
        keyed = keyed.where(F.col("k") <= F.length("word")).select("word", F.substr("word", F.lit(1), F.col("k")).alias("prefix"))
        hot, _ = settled(keyed.groupBy("prefix").agg(F.count("*").alias("n_words")).where(F.col("n_words") > limit).select("prefix"))
        deep = dim_join(keyed, hot, ["prefix"], spread_by="word").groupBy("word").agg(F.count("*").cast("int").alias("over"))
        found = left.join(deep, "word", "left").select(*words.columns, F.coalesce("over", F.lit(0)).alias("over"))
        parts.append(found.where(F.col("over") < LEVELS).select(*words.columns, (F.col("over") + level + 1).alias("depth")))
        level += LEVELS
        if hot.where(F.length("prefix") == level).isEmpty():
            return reduce(DataFrame.unionByName, parts)
        left = pin(found.where(F.col("over") == LEVELS).drop("over"))


def _composed(placed: DataFrame, tasks: int) -> DataFrame:
    """Pairs inside partitions: both words share the prefix that names the partition."""
    state = F.substr("word", F.lit(1), F.col("depth"))
    rows = placed.where(F.col("depth") <= F.length("word"))
    rows = rows.withColumn("task", F.pmod(F.xxhash64(state), F.lit(tasks)).cast("int"))
    return rows.groupBy("task").applyInArrow(_near_in_partition, "word string, near string, near_n bigint")


def _members(key: list[str], members: DataFrame) -> DataFrame:
    """Pairs of members with one key of which at least one lost a code point (`lost`) there.

    All members are near each other, but for one that goes on with the lost code point: that pair
    shares more of its start and is found there. Members are words that differ in one place, so
    there are at most as many as the alphabet has code points, and one.
    """
    groups = members.groupBy(*key).agg(F.collect_list(F.struct("word", "n", "lost", "following")).alias("m"))
    groups = groups.where(F.size("m") > 1).select("m", F.explode("m").alias("u"))
    pairs = groups.select("u", F.explode("m").alias("v"))
    apart = (F.col("u.word") != F.col("v.word")) & ~F.col("u.lost").eqNullSafe(F.col("v.following")) & ~F.col("v.lost").eqNullSafe(F.col("u.following"))
    # A word that lost nothing has no `lost` code point: null equals no following one.
    return pairs.where(apart).select(F.col("u.word").alias("word"), F.col("v.word").alias("near"), F.col("v.n").alias("near_n"))


def _parted_above(placed: DataFrame) -> DataFrame:
    """Pairs that part in a state above the partitions, met by the prefix and what follows the edit."""
    at = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    ways = F.array(
        F.struct(F.substr("word", F.col("k") + 2).alias("rest"), F.substr("word", F.col("k") + 1, F.lit(1)).alias("lost"), F.lit("").alias("following")),
        F.struct(F.substr("word", F.col("k") + 1).alias("rest"), F.lit(None).cast("string").alias("lost"), F.substr("word", F.col("k") + 1, F.lit(1)).alias("following")),
    )
    entries = at.select("word", "n", F.substr("word", F.lit(1), F.col("k")).alias("prefix"), F.inline(ways))
    # At its end a word has no code point to lose.
    entries = entries.where((F.length("prefix") < F.length("word")) | F.col("lost").isNull())
    return _members(["prefix", "rest"], entries)


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each long word the hash of it all (place -1), and those of it without each code point."""
    factor = int(seeded(1, 72)[0] | np.uint64(1))
    inverse = np.uint64(pow(factor, -1, 1 << 64))
    for batch in batches:
        for name, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
            symbols = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32))
            powers = np.cumprod(np.r_[np.uint64(1), np.full(len(symbols) - 1, np.uint64(factor))])
            sums = np.r_[np.uint64(0), np.cumsum(symbols * powers)]
            hashes = np.r_[sums[-1], sums[:-1] + (sums[-1] - sums[1:]) * inverse]
            for at in range(0, len(hashes), 100_000):
                part = hashes[at : at + 100_000]
                places = pa.array(np.arange(at - 1, at - 1 + len(part), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), name)), places, pa.array(part.view(np.int64))], ["id", "place", "hash"]
                )


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs of which one word is over LONGEST code points; linear in the letters of such words."""
    some = pin(words.where(F.length("word") >= LONGEST).select(F.xxhash64("word").alias("id"), "word", "n"))
    entries = pin(some.select("id", "word").mapInArrow(_left_out, "id bigint, place int, hash bigint"))
    lost = entries.where("place >= 0")
    changed = lost.toDF("u", "place", "hash").join(lost.toDF("v", "place", "hash"), ["place", "hash"]).where("u <> v")
    shorter = lost.groupBy(F.col("id").alias("u"), "hash").agg(F.min("place").alias("place"))
    shorter = shorter.join(entries.where("place < 0").select(F.col("id").alias("v"), "hash"), "hash")

    def cut(word: str) -> Column:
        return F.concat(F.substr(word, F.lit(1), F.col("place")), F.substr(word, F.col("place") + 2))

    def with_words(pairs: DataFrame) -> DataFrame:
        named = pairs.select("u", "v", "place").join(some.toDF("u", "word", "n"), "u").join(some.toDF("v", "near", "near_n"), "v")
        return named.where((F.length("word") > LONGEST) | (F.length("near") > LONGEST))

    changed = with_words(changed).where(cut("word") == cut("near")).select("word", "near", "near_n")
    shorter = with_words(shorter).where(cut("word") == F.col("near"))
    longer = shorter.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return changed.unionByName(shorter.select("word", "near", "near_n")).unionByName(longer)


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n for every ordered pair of words (word, n) one edit apart; words are distinct."""
    size = words.agg(F.count("*").alias("words"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest")).first()
    short = words.where(F.length("word") <= LONGEST)
    if size.words > limit:
        placed = pin(_placed(short, limit))
        found = _composed(placed, -(-size.words // limit)).unionByName(_parted_above(placed))
    else:
        found = _composed(short.withColumn("depth", F.lit(0)), 1)
    return found.unionByName(_long_pairs(words)) if size.longest > LONGEST else found


# --- forms and roots ---------------------------------------------------------------------------


def variants(docs: DataFrame, limit: int = LIMIT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts.

    A word's form is its most frequent near word, if that is at least `times` as frequent; its
    root is the last of the forms that follow one another.
    """
    words, _ = settled(vocabulary(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("o"), F.col("near").alias("near")))
    near = near_words(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.o"))
    common = F.col("form_n") >= times * F.col("n")
    found = pin(
        found.select(
            "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(common, F.col("form_n")).alias("form_n"),
        )
    )
    # Each form is `times` as frequent, which bounds how many follow one another; each join doubles the steps.
    most = found.agg(F.max("form_n")).first()[0] or 1
    steps, reached = 0, MIN_COUNT
    while reached < most and times > 1:
        reached, steps = reached * times, steps + 1
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
