"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its word shingles. Its signature has `chunks * width` symbols of b bits,
one per hash function: the low bits of the smallest hash. Two documents of similarity s agree in a
symbol with probability of about s, so near copies have signatures at a small Hamming distance.
The join splits signatures into chunks. If two signatures differ in at most 2 * chunks - 1
symbols, then by the pigeonhole principle some chunk has at most one differing symbol; every
chunk is therefore listed once for each symbol it may be wrong in, with that symbol left out,
and equal entries meet. All pairs within the distance are found, and pairs beyond it with a
probability that falls slowly. At similarity 0.8 the chance that no chunk meets is below 1e-5.

Documents with equal sets are one class before any comparison. Links are confirmed on full sets.
An entry shared by many classes never forms all pairs. Its members are compared with one pivot,
the document that shares most entries. Members linked to the pivot are connected. For an outer
member x, not linked to the pivot p, and another member y, what x and y share lies in p's set, or
is a shingle that both have and p has not. The first part is at most what x shares with p, which
is known, so x and y can only be linked if they share enough of the second kind (or, if no such
shingle is needed, y's set is smaller than p's). Such shingles that no third member has are of no
use; ordered by how many members have them, the first one that x and y share leaves enough behind
it in both. A member therefore only offers the rarest of its shingles, and most offer none. Pairs
that meet by one are compared if their shingles allow a link; a shingle that many members offer
makes a group instead, treated as an entry again, until all members of each are connected or
compared. A share of a group's members, growing with every round, meets all others beside the pivot
and then leaves, so groups end after few rounds. Of these meetings only those are compared in which
the shingles that both have beside the pivot's, and what each shares with the pivot, allow a link.

Null or empty texts and texts without words have an empty set and no links. Texts with fewer
words than a shingle are one shingle. Equal rows share a class; a row without an id is linked
with nothing (component null, kept). Columns other than the id and the text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.llm.common import (
    BYTE_VALUES, LOWER, SPACE, free_name, mix, runs, seeded, settled, slices, span_hashes, windows,
)
from tallyweave.llm.components import components
from tallyweave.session import pin


@dataclass(frozen=True)
class Scheme:
    shingle: int = 5
    percent: int = 80
    chunks: int = 11
    width: int = 6
    # A further shingle that at most this many members of a pivot share is probed pair by pair.
    direct: int = 64
    # Further pivots of a group, and how many times as many each round takes; they end mixed groups
    # in a number of rounds that grows with the logarithm of the largest one.
    further: int = 64
    growth: int = 16

    @property
    def symbols(self) -> int:
        return self.chunks * self.width


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row."""
    starts, ends, bounds = runs(~SPACE[data], offsets)
    words = span_hashes(BYTE_VALUES[0][LOWER[data]], starts, ends)
    at, rows = windows(words, bounds, k)
    lengths = np.diff(bounds)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    begin = np.r_[at, bounds[short]]
    hashes = span_hashes(words, begin, np.r_[at + k, bounds[short + 1]])
    rows = np.r_[rows, short]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def _signatures(scheme: Scheme):
    factors = seeded(scheme.symbols, 21) | np.uint64(1)
    shifts = seeded(scheme.symbols, 22)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                rows, hashes = shingle_hashes(data, offsets, scheme.shingle)
                filled, cuts = np.unique(rows, return_index=True)
                symbols = np.zeros((end - first, scheme.symbols), np.uint8)
                for j in range(scheme.symbols) if len(rows) else ():
                    least = np.minimum.reduceat(hashes * factors[j] + shifts[j], cuts)
                    symbols[filled, j] = mix(least) & np.uint64(255)
                sums = np.zeros((2, end - first), np.uint64)
                if len(rows):
                    sums[0, filled] = np.add.reduceat(mix(hashes ^ shifts[0]), cuts)
                    sums[1, filled] = np.add.reduceat(mix(hashes ^ shifts[1]), cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        pa.array(np.bincount(rows, minlength=end - first).astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([r.tobytes() for r in symbols], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "symbols"],
                )

    return run


def signatures(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (together the set's identity), symbols."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        _signatures(scheme), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, symbols binary"
    )


def _index_entries(scheme: Scheme):
    salts = seeded(scheme.symbols, 23)
    weights = seeded(scheme.width, 24) | np.uint64(1)
    values = seeded(256, 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            symbols = np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.uint8)
            parts = values[symbols].reshape(n, scheme.chunks, scheme.width) * weights
            whole = parts.sum(2, dtype=np.uint64)
            # One entry per chunk and symbol left out: the sum without that symbol's part.
            entries = mix((whole[:, :, None] - parts).reshape(n, -1) ^ salts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entries.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(batch.column("doc_id").to_numpy(), scheme.symbols)),
                ],
                ["entry", "doc"],
            )

    return run


def _compare(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs mostly arrive by pivot, so its set is often the one just made.
        last, pivot = None, np.zeros(0, np.uint64)

        def hashes(text: str) -> np.ndarray:
            data = np.frombuffer((text or "").encode(), np.uint8)
            return shingle_hashes(data, np.array([0, len(data)]), scheme.shingle)[1]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b, many = (part.column(c).to_pylist() for c in ("a", "b", "many"))
                texts_a, texts_b = part.column("text_a"), part.column("text_b")
                common, size_a, size_b, more = [], [], [], []
                for i in range(len(a)):
                    if a[i] != last:
                        last, pivot = a[i], hashes(texts_a[i].as_py())
                    other = hashes(texts_b[i].as_py())
                    # A row of a repeated id may have an empty text: it shares nothing.
                    held = np.zeros(len(other), bool)
                    if len(pivot):
                        held = pivot[np.minimum(np.searchsorted(pivot, other), len(pivot) - 1)] == other
                    n, both = len(other), int(held.sum())
                    common.append(both)
                    size_a.append(len(pivot))
                    size_b.append(n)
                    more.append(other[~held].view(np.int64) if many[i] else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("a"), part.column("b"), part.column("many"), *[pa.array(x, pa.int64()) for x in (common, size_a, size_b)],
                        pa.array(more, pa.list_(pa.int64())),
                    ],
                    ["a", "b", "many", "common", "n_a", "n_b", "added"],
                )

    return run


# A broadcast of that many ids takes some 10 MB with its hash table.
BROADCAST_IDS = 200_000
# Pivots with their few numbers, some 100 bytes each.
BROADCAST_PIVOTS = 50_000


def _enough(common: Column, n_a: Column, n_b: Column, scheme: Scheme) -> Column:
    return (100 + scheme.percent) * common >= scheme.percent * (n_a + n_b)


def _compared(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """For pairs (a, b, many): sizes, common shingles, whether they are linked, and, where many is
    set, the shingles of b that a does not have."""
    pairs, count = settled(pairs, 2_000)
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    if 2 * count <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # One text per class; a table that repeats an id with other texts links them all.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").join(wanted, "doc", "left_semi")
    full = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    schema = "a bigint, b bigint, many boolean, common bigint, n_a bigint, n_b bigint, added array<bigint>"
    found = full.select("a", "b", "many", "text_a", "text_b").mapInArrow(_compare(scheme), schema)
    return settled(found.withColumn("linked", (F.col("common") > 0) & _enough(F.col("common"), F.col("n_a"), F.col("n_b"), scheme)), 2_000)[0]


def _pivots(groups: DataFrame) -> DataFrame:
    """Each group's pivot (a): the member that meets most others."""
    sizes = groups.groupBy("entry").agg(F.count("*").alias("n"))
    meets = groups.join(sizes, "entry").groupBy("doc").agg(F.sum("n").alias("meets"))
    pivots = groups.join(meets, "doc").groupBy("entry").agg(F.max(F.struct("meets", (-F.col("doc")).alias("o"))).alias("p"))
    return pivots.select("entry", (-F.col("p.o")).alias("a"))


def _pivot_pairs(groups: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each group's members (b) with its pivot (a)."""
    pairs = groups.select("entry", F.col("doc").alias("b")).join(pivots, "entry")
    pairs = pairs.where("a <> b").select("a", "b").distinct()
    hubs = pairs.groupBy("a").agg((F.count("*") > 1).alias("many"))
    return pairs.join(hubs, "a")


def _required(n_a: Column, n_b: Column, scheme: Scheme) -> Column:
    """Fewest common shingles of two linked sets."""
    return F.ceil(scheme.percent * (n_a + n_b) / F.lit(100.0 + scheme.percent) - 1e-9)


def _left_over(tested: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """Pairs, and groups of members, that may hold links the pivots missed."""
    share = scheme.percent / (100.0 + scheme.percent)
    hubs = tested.groupBy("a").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("linked")).alias("apart"),
        F.min("n_b").alias("least"),
        F.min(F.when(~F.col("linked"), share * F.col("n_b") - F.col("common"))).alias("base"),
    )
    # The fewest further shingles that an outer member shares with another one it is linked to, and
    # the fewest of all outer members, which holds for those that are linked to the pivot.
    lowest = F.greatest(F.lit(1), F.ceil(F.col("base") + share * F.col("least") - 1e-9))
    hubs, n_hubs = settled(hubs.where("n > 1 AND apart > 0").select("a", "least", lowest.alias("lowest")))
    if n_hubs <= BROADCAST_PIVOTS:
        hubs = F.broadcast(hubs)
    needed = F.greatest(F.lit(1), _required(F.col("n_b"), F.col("least"), scheme) - F.col("common"))
    around = tested.join(hubs, "a").withColumn("needed", F.when(F.col("linked"), F.col("lowest")).otherwise(needed))

    # Pairs that need no further shingle: what both share with the pivot is enough, and the other's
    # set is smaller than the pivot's.
    smaller = around.where("n_b < n_a").select("a", F.col("b").alias("y"), F.col("common").alias("c_y"), F.col("n_b").alias("n_y"))
    outer = around.where(~F.col("linked") & _enough(F.col("common"), F.col("n_b"), F.col("least"), scheme))
    outer = outer.select("a", F.col("b").alias("x"), F.col("common").alias("c_x"), F.col("n_b").alias("n_x"))
    fits = _enough(F.least("c_x", "c_y"), F.col("n_x"), F.col("n_y"), scheme)
    pairs = outer.join(smaller, "a").where(fits & (F.col("x") != F.col("y")))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    keyed = around.select("a", "b", "linked", "needed", "common", "n_b", F.explode("added").alias("shingle"))
    several = keyed.groupBy("a", "shingle").agg(F.count("*").alias("f")).where("f > 1")
    keyed = keyed.join(several, ["a", "shingle"])
    own = Window.partitionBy("a", "b")
    keyed = keyed.withColumns({"shared": F.count("*").over(own), "place": F.row_number().over(own.orderBy("f", "shingle"))})
    # Of its shared ones, a member can spare all but the needed before it meets the first in common.
    offered = keyed.where("place <= shared - needed + 1").select(
        "a", "shingle", "b", "linked", "common", "n_b", (F.col("shared") - F.col("place") + 1).alias("behind")
    )
    offered, _ = settled(offered)
    offers = offered.groupBy("a", "shingle").agg(F.count("*").alias("f"), F.count_if(~F.col("linked")).alias("outer"))
    offered = offered.join(offers.where("f > 1 AND outer > 0"), ["a", "shingle"])
    few = offered.where(F.col("f") <= scheme.direct)
    one = few.where("NOT linked").select("a", "shingle", *[F.col(n).alias(f"{n}_x") for n in ("b", "common", "n_b", "behind")])
    two = few.select("a", "shingle", *[F.col(n).alias(f"{n}_y") for n in ("b", "common", "n_b", "behind")])
    at_least = _required(F.col("n_b_x"), F.col("n_b_y"), scheme) - F.least("common_x", "common_y")
    on = [one["a"] == two["a"], one["shingle"] == two["shingle"], one["b_x"] != two["b_y"], F.least("behind_x", "behind_y") >= at_least]
    met = one.join(two, on).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()
    groups = offered.where(F.col("f") > scheme.direct)
    return pairs.unionByName(met).distinct(), groups.select("a", F.xxhash64("a", "shingle").alias("entry"), F.col("b").alias("doc"))


def _further_pivots(stars: DataFrame, wanted: int) -> DataFrame:
    """About `wanted` members (p) of each pivot (a), by a hash; all of them where there are fewer."""
    sizes = stars.groupBy("a").agg(F.count("*").alias("n"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(wanted), "b"), 11) / F.lit(2.0**53)
    return stars.join(sizes, "a").where(chance * F.col("n") < wanted).select("a", F.col("b").alias("p"))


def _meetings(members: DataFrame, picked: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs of a further pivot and a member of another component that may be linked.

    Both belonged to an earlier pivot (old): they share at most what each shares with that one,
    and the shingles both have beside it.
    """
    facts = ("doc", "component", "common", "n_b", "added")
    one = members.join(picked.select("a", F.col("p").alias("doc")), ["a", "doc"])
    one = one.select("old", "a", *[F.col(n).alias(f"{n}_x") for n in facts])
    two = members.select("old", "a", *[F.col(n).alias(f"{n}_y") for n in facts])
    needed = _required(F.col("n_b_x"), F.col("n_b_y"), scheme) - F.least("common_x", "common_y")
    possible = F.least(F.size("added_x"), F.size("added_y")) >= needed
    possible = possible & (F.size(F.array_intersect("added_x", "added_y")) >= needed)
    met = one.join(two, ["old", "a"]).where((F.col("component_x") != F.col("component_y")) & possible)
    return met.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()


def _mixed(groups: DataFrame, named: DataFrame) -> tuple[DataFrame, int]:
    """Members of groups that hold more than one component, and their number."""
    held = groups.join(named.withColumnRenamed("node", "doc"), "doc", "left")
    held = held.withColumn("component", F.coalesce("component", "doc"))
    several = held.groupBy("entry").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return settled(held.join(several.where("least <> most").select("entry"), "entry"))


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs that are not in one component yet."""
    ends = pairs.join(named.toDF("a", "of_a"), "a", "left").join(named.toDF("b", "of_b"), "b", "left")
    return ends.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def links(docs: DataFrame, sets: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """Confirmed links (a, b) between class representatives that connect every component.

    `sets` is the result of `signatures`. Pairs already connected by other links are left out.
    """
    some = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps, _ = settled(
        some.groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("doc_id", "symbols")).alias("r"))
        .select(F.col("r.doc_id").alias("doc_id"), F.col("r.symbols").alias("symbols"))
    )
    entries = reps.mapInArrow(_index_entries(scheme), "entry bigint, doc bigint")
    shared = entries.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    groups, _ = settled(entries.join(shared, "entry").select("entry", "doc"))
    tested = _compared(_pivot_pairs(groups, _pivots(groups)), docs, scheme)
    linked = tested.where("linked").select("a", "b")
    picked, wanted = None, scheme.further
    while True:
        pairs, groups = _left_over(tested.where("many"), scheme)
        # A further pivot has met all members: it is left with none.
        groups = groups if picked is None else groups.join(picked.withColumnRenamed("p", "doc"), ["a", "doc"], "left_anti")
        named = components(linked)
        groups, size = _mixed(groups.select("entry", "doc", F.col("a").alias("old")), named)
        if size:
            pivots = _pivots(groups)
            stars, _ = settled(_pivot_pairs(groups, pivots))
            picked, _ = settled(_further_pivots(stars, wanted))
            members = groups.join(pivots, "entry").where("doc <> a").select("old", "a", "doc", "component").distinct()
            facts = tested.where("many").select(F.col("a").alias("old"), F.col("b").alias("doc"), "common", "n_b", "added")
            met = _meetings(members.join(facts, ["old", "doc"]), picked, scheme)
            pairs = pairs.unionByName(met).distinct()
            wanted *= scheme.growth
        pairs = _apart(pairs, named).withColumn("many", F.lit(False))
        if size:
            pairs = pairs.join(stars, ["a", "b"], "left_anti").unionByName(stars)
        tested = _compared(pairs, docs, scheme)
        linked = linked.unionByName(tested.where("linked").select("a", "b"))
        if not size:
            return linked


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sets = pin(signatures(docs, scheme))
    key = ["set_a", "set_b", "n_shingles"]
    classes = sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    named = components(links(docs, sets, scheme)).withColumnRenamed("node", "rep")
    classes = classes.join(named, "rep", "left").select(*key, F.coalesce("component", "rep").alias("class_id"))
    # Empty sets take no part; their own id names them.
    own = sets.join(classes, key, "left")
    found = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    found = F.when(F.col("doc_id").isNotNull(), found)
    return own.select("doc_id", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """The rows of docs of which one document per component stays, with all their columns.

    Rows that share an id are one document and stay or go together.
    """
    gone = free_name(docs, "gone")
    others = near_duplicates(docs, scheme).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")
