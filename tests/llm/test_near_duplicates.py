"""Near-duplicates and components against brute force."""

import itertools

import numpy as np
import pytest

from tallyweave.llm import near_duplicates
from tallyweave.llm.components import components
from tallyweave.llm.near_duplicates import Scheme
from tests.llm import plain

FOUR = Scheme(shingle=4)


def edited(spark, n=80):
    """Chains of edits, so that similarities lie on both sides of the threshold."""
    random = np.random.default_rng(3)
    texts = []
    for family in range(5):
        own = plain.words(int(random.integers(25, 120)), 300 + family)
        for d in range(n // 5):
            if random.random() < 0.5:
                own = list(own)
                own[int(random.integers(len(own)))] = f"e{family}x{d}"
            texts.append(" ".join(own))
    return plain.docs(spark, texts)


def families(spark):
    """Random edits, deletions and insertions of a few texts: most members are near the original
    only, some near each other."""
    random = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = plain.words(90, 500 + family)
        variants = [base]
        for d in range(40):
            own = list(variants[int(random.integers(len(variants)))])
            for _ in range(int(random.integers(0, 6))):
                at, kind = int(random.integers(len(own))), random.integers(3)
                own[at : at + 1] = [[f"e{random.integers(12)}"], [], [own[at], f"i{d}"]][kind]
            if random.random() < 0.2:
                variants.append(own)
            texts.append(" ".join(own))
    return plain.docs(spark, texts)


def large_families(spark):
    """One family of 200 members, and prefixes of one text that lie in one another."""
    random = np.random.default_rng(17)
    base, texts = plain.words(70, 900), []
    for d in range(200):
        own = list(base)
        for _ in range(int(random.integers(1, 7))):
            own[int(random.integers(len(own)))] = f"e{random.integers(9)}"
        texts.append(" ".join(own))
    long = plain.words(160, 901)
    texts += [" ".join(long[: int(k)]) for k in random.integers(90, 160, 30)]
    return plain.docs(spark, texts)


@pytest.mark.parametrize("make", [plain.documents_of, edited, families, large_families])
def test_components_as_brute_force(spark, make):
    table = make(spark)
    plain.same(near_duplicates.near_duplicates(table, FOUR), plain.components_of(table))


@pytest.mark.parametrize("make", [families, large_families])
@pytest.mark.parametrize("scheme", [Scheme(shingle=4, direct=1, further=2, growth=2), Scheme(shingle=4, direct=4)])
def test_pivots_lose_no_link(spark, make, scheme):
    # Further shingles make groups instead of pairs, which take several rounds.
    table = make(spark)
    plain.same(near_duplicates.near_duplicates(table, scheme), plain.components_of(table))


def test_signatures_within_the_distance_always_meet():
    scheme = Scheme()
    random = np.random.default_rng(1)
    import pyarrow as pa

    for _ in range(200):
        a = random.integers(0, 256, scheme.symbols, dtype=np.uint8)
        b = a.copy()
        at = random.choice(scheme.symbols, 2 * scheme.chunks - 1, replace=False)
        b[at] ^= np.uint8(1)
        batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "symbols": [a.tobytes(), b.tobytes()]})
        (out,) = near_duplicates._index_entries(scheme)(iter([batch]))
        entries, docs = out.column(0).to_pylist(), out.column(1).to_pylist()
        one, two = ({e for e, d in zip(entries, docs) if d == x} for x in (1, 2))
        assert one & two


def test_an_empty_pivot_shares_nothing():
    import pyarrow as pa

    texts = {"a": [1, 1, 1], "b": [2, 2, 3], "many": [True] * 3, "text_a": ["", None, ""], "text_b": ["one two three four five", "", None]}
    (out,) = near_duplicates._compare(FOUR)(iter([pa.RecordBatch.from_pydict(texts)]))
    assert out.column("common").to_pylist() == [0, 0, 0] and out.column("n_b").to_pylist() == [2, 0, 0]


def test_one_document_of_each_group_stays(spark):
    table = plain.documents_of(spark)
    kept = near_duplicates.deduplicate(table, FOUR)
    assert kept.schema == table.schema
    expected = [r["doc_id"] for r in plain.components_of(table) if r["kept"]]
    assert sorted(r.doc_id is None or r.doc_id for r in kept.collect()) == sorted(i is None or i for i in expected)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + list(itertools.pairwise([300, 250, 400, 260]))
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(table).collect()}
    assert {r.node: r.component for r in components(table, task_edges=9).collect()} == got
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert {got[i] for i in (300, 250, 400, 260)} == {250} and len(got) == 41 + 60 + 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert near_duplicates.deduplicate(empty).count() == 0
