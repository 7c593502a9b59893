"""Vector codes: tries against plain distances, and the whole query against SQL and integers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyweave.llm import vector_codes as vc
from tests.llm import plain

ROWS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("part", "position", "weight", "entry", "l", "error")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], ROWS)


@pytest.mark.parametrize("seed", range(10))
def test_trie_as_plain_distances(seed):
    r = np.random.default_rng(seed)
    rows = r.integers(-3, 3, (400, 4))
    rows = rows[np.lexsort(rows.T[::-1])]
    book = r.integers(-3, 3, (16, 4))
    trie, entry, distance, made = vc.Trie(book), [], [], 0
    cuts = np.sort(r.integers(0, 400, 6))
    for part in np.split(rows, cuts):
        if len(part):
            e, d, new = trie.leaves(part)
            entry += list(e)
            distance += list(d)
            made += new
    far = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert entry == list(far.argmin(1)) and distance == list(far.min(1))
    # Every prefix is worked out once, over all blocks.
    assert made == sum(len(np.unique(rows[:, :k], axis=0)) for k in range(1, 5))


def brute_force(rows, parts=8):
    """All in Python integers."""
    import math

    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) % parts == 0]
    if not usable or all(r[0] is None for r in usable):
        return []
    dims = len(min(usable, key=lambda r: (r[0] is None, r[0] or 0, len(r[1])))[1])
    most = vc._limit(dims)
    kept = [(r[0], [max(-most, min(most, math.floor(4096 * float(np.float32(x))))) for x in r[1]], r[2]) for r in usable if len(r[1]) == dims]
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    start = sorted((r[0], r[1]) for r in kept if r[0] is not None)[:16]
    books = [[cut(v, p) for _, v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v, p):
        return min((far(cut(v, p), b), e) for e, b in enumerate(books[p]))

    for _ in range(6):
        taken = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                members = [cut(kept[i][1], p) for i in range(len(kept)) if taken[i][p] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for book in books for b in book for x in b).encode()).hexdigest()
    out = []
    for id_, v, label in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append([id_, bytes(e for _, e in found).hex(), sum(d for d, _ in found), label])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return [(*r[:3], total[r[3]] if total[r[3]] < 2**63 else None, digest) for r in out]


def some_rows(n=300):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.2, 16).round(2)], int(i % 4)) for i in r.permutation(n)]
    rows += [(7, rows[0][1], None), (8, rows[1][1], None), (None, rows[2][1], 2)]  # repeated and missing ids, null labels
    rows += [(9, rows[3][1], 1)] * 40  # one very common vector
    return rows


def test_report_as_brute_force(spark):
    rows = some_rows()
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.5] * 15, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] * 16, 1)]
    rows += [(1005, [0.5] * 24, 1), (1006, [0.5] * 9, 1), (1007, [3e38] * 16, 1), (1008, [-3e38] * 16, 3)]
    got = vc.report(table(spark, rows))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    plain.same(got, brute_force(rows))


def test_report_as_sql(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(1002, [None] + [0.5] * 15, 1), (1003, None, None)]
    data = table(spark, rows).select("vec_id", "embedding", "label")
    plain.same_as_sql(vc.report(data), vc.ORACLE, embeddings=data)


def test_few_and_no_rows(spark):
    rows = some_rows()[:5]
    plain.same(vc.report(table(spark, rows)), brute_force(rows))
    one = [(3, [0.25] * 8, None)]
    plain.same(vc.report(table(spark, one)), brute_force(one))
    for none in ([], [(1, None, 1)], [(None, [0.5] * 8, 1)]):
        assert vc.report(table(spark, none)).count() == 0


def test_extra_columns_stay(spark):
    data = table(spark, some_rows()[:40])
    coded, _ = vc.compress(data)
    assert [c for c in coded.columns if c not in ("code", "error")] == [c for c in data.columns if c != "error"]
