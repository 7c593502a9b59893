"""Deletion of repeated bytes, words and lines against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import block_anchors, exchange, line_dedup, suffix_repeats
from tests.llm import plain


def deleted_bytes(table):
    left = suffix_repeats.delete_repeats(table)
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def deleted_words(table):
    left = block_anchors.delete_repeats(table)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def mutated(spark):
    """Many overlapping passages in different surroundings, some with one word or byte changed."""
    random = np.random.default_rng(7)
    passages = [plain.words(int(random.integers(8, 90)), 50 + p) for p in range(6)]
    texts = []
    for d in range(60):
        parts = []
        for p in random.integers(0, 6, 3):
            own = list(passages[p])
            if random.random() < 0.6:
                own[int(random.integers(len(own)))] = f"changed{d}"
            cut = int(random.integers(0, len(own)))
            parts += own[cut:] if random.random() < 0.4 else own
            parts += plain.words(int(random.integers(0, 20)), 1000 + d)
        texts.append(" ".join(parts))
    return plain.docs(spark, texts)


@pytest.mark.parametrize("make", [plain.documents_of, mutated])
def test_bytes_as_brute_force(spark, make):
    table = make(spark)
    plain.same(deleted_bytes(table), plain.later_strings(table))


@pytest.mark.parametrize("make", [plain.documents_of, mutated])
def test_words_as_brute_force(spark, make):
    table = make(spark)
    plain.same(deleted_words(table), plain.later_windows(table))


def test_hot_anchors_give_the_same_bytes(spark, monkeypatch):
    table = mutated(spark)
    split = suffix_repeats._SuffixRepeats(50, hot=1)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    got = exchange.two_rounds(table, split, schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, suffix_repeats.delete_repeats(table).collect()))


def test_an_anchor_of_one_long_text_is_split(spark):
    random = np.random.default_rng(5)
    data = random.integers(97, 123, 200_000).astype(np.uint8)
    at = int(suffix_repeats.rolling_sums(suffix_repeats.BYTE_VALUES[0][data], suffix_repeats.ANCHOR).argmin())
    # The string with the smallest hash of all is the anchor of all strings that hold it.
    anchor, fill = data[at : at + suffix_repeats.ANCHOR].tobytes().decode(), data.tobytes().decode()
    long = "".join(fill[i * 40 : i * 40 + 40] + anchor for i in range(300))
    texts = exchange.Texts(np.array([1, 2]), np.array([True, True]), __import__("pyarrow").array([long, long[500:900]]))
    method = suffix_repeats._SuffixRepeats(50, hot=200)
    asked = method.ask(texts, 1)
    (answer,) = method.meet(0, [asked[0]])
    assert answer[1].sum() == 1
    table = plain.docs(spark, [long, long[500:900], "x" + long[700:1200]])
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary"
    got = exchange.two_rounds(table, method, schema).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    plain.same(got, plain.later_strings(table))


def test_long_text_comes_in_parts(spark, monkeypatch):
    text = " ".join(plain.words(3_000, 5, 3))
    texts = exchange.Texts(np.array([1]), np.array([True]), __import__("pyarrow").array([text]))
    whole = suffix_repeats.regions(texts)
    monkeypatch.setattr(suffix_repeats, "_SEGMENT", 1_000)
    parts = suffix_repeats.regions(texts)
    # Parts only cut regions: the same strings have the same anchors.
    def strings(r):
        return sorted((s + w, a) for s, n, a in zip(r.starts.tolist(), r.windows.tolist(), r.anchors.tolist()) for w in range(n))
    assert strings(whole) == strings(parts)


def test_repeat_groups_have_all_occurrences(spark):
    passage = " ".join(plain.words(12, 9))
    table = plain.docs(spark, [f"aa {passage} bb", f"cc {passage} dd", f"ee {passage} ff", "nothing else here " * 5])
    found = suffix_repeats.repeat_groups(table)
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    groups = {}
    for r in found.collect():
        groups.setdefault(r.repeat, set()).add(texts[r.doc_id][r.start : r.start + r.length])
    assert groups and all(len(g) == 1 for g in groups.values())
    # Together they cover the passage in every document that has it.
    for d in range(3):
        marks = bytearray(len(texts[d]))
        for r in found.where(f"doc_id = {d}").collect():
            marks[r.start : r.start + r.length] = b"\1" * r.length
        assert sum(marks) == len(passage) + 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=14).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(2, 4))
def test_intervals_are_the_maximal_repeats(texts, least):
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = suffix_repeats.suffix_array(data, np.cumsum(lengths) - lengths, lengths, least)
    got = set()
    for a, b, length, low in suffix_repeats.common_prefix_intervals(found.lcp.tolist(), found.left.tolist(), found.text.tolist(), least):
        places = frozenset(zip(found.text[a : b + 1].tolist(), found.offset[a : b + 1].tolist()))
        assert low == min(t for t, _ in places)
        got.add((length, places))
    want, strings = set(), {t[i:j] for t in texts for i in range(len(t)) for j in range(i + least, len(t) + 1)}
    for s in strings:
        places = [(n, i) for n, t in enumerate(texts) for i in range(len(t)) if t.startswith(s, i)]
        lefts = [texts[n][i - 1] if i else -1 for n, i in places]
        rights = [texts[n][i + len(s)] if i + len(s) < len(texts[n]) else -1 for n, i in places]
        differ = lambda side: len(set(side)) > 1 or -1 in side
        if len(places) > 1 and differ(lefts) and differ(rights):
            want.add((len(s), frozenset(places)))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.booleans())
def test_packed_arrays_come_back(values, rising):
    wide = np.array(sorted(values) if rising else values, np.uint64)
    small = (wide % np.uint64(256)).astype(np.uint8)
    back = exchange.unpack(exchange.pack([wide, small, wide.view(np.int64), wide.astype(np.uint32)]))
    for a, b in zip(back, [wide, small, wide.view(np.int64), wide.astype(np.uint32)]):
        assert a.dtype == b.dtype and (a == b).all()


def test_lines_as_sql(spark):
    table = plain.documents_of(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plain.same_as_sql(line_dedup.report(table), line_dedup.ORACLE, documents=table.select("doc_id", "text"))


def test_lines_of_repeated_rows_and_other_columns(spark):
    table = plain.documents_of(spark)
    left = line_dedup.clean(table)
    assert left.schema == table.schema
    # A row given twice is one document and keeps its text; its later copy goes.
    single = [r.text for r in left.where("doc_id IN (16, 17)").orderBy("doc_id").collect()]
    assert single == ["same line\nnext line\nthird line", "zero\n"]
    assert left.where("doc_id = 9").count() == 2


def test_a_long_line_between_other_lines_is_a_run(spark):
    long, short = " ".join(plain.words(50, 31)), " ".join(plain.words(49, 32))
    table = plain.docs(spark, [f"a 1\n{long}\nb 1\n{short}", f"a 2\n  {long}\t\nb 2\n{short}\nc 2\n{long}", long, f"{long} more", f"a 3\n{short}"])
    table = table.unionByName(table.where("doc_id < 2")).unionByName(table.where("doc_id = 4").withColumn("text", F.lit(f"{long}\nother")))
    left = {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, table, "").collect()}
    assert left == {
        (0, f"a 1\n{long}\nb 1\n{short}"), (1, f"a 2\nb 2\n{short}\nc 2"), (3, f"{long} more"), (4, f"a 3\n{short}"), (4, "other"),
    }
    # The query's SQL asks for two lines.
    assert line_dedup.report(table).where("doc_id < 2 AND n_removed > 0").count() == 0


@pytest.mark.parametrize("operator", [deleted_bytes, deleted_words, line_dedup.report, line_dedup.clean, suffix_repeats.repeat_groups])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], plain.DOCS)).count() == 0


def test_chunks_of_a_box_share_rows(spark, monkeypatch):
    """A row for every chunk and bucket made the rows grow with the square of the texts."""
    table = mutated(spark)
    expected = sorted(map(tuple, deleted_bytes(table).collect()))
    for name, value in (("CHUNK_BYTES", 1500), ("BUCKET_BYTES", 4000), ("CORE_BOXES", 1)):
        monkeypatch.setattr(exchange, name, value)
    made, sent = exchange._rows, {}
    for size in (1, 4):
        sent[size] = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(exchange, "BOX_CHUNKS", size)
        monkeypatch.setattr(exchange, "_rows", lambda parts, box, turn, seen=sent[size]: (seen.add(len(parts)), made(parts, box, turn))[1])
        assert sorted(map(tuple, deleted_bytes(table).collect())) == expected
    assert 0 < 3 * sent[4].value < 2 * sent[1].value


def test_arrays_of_several_chunks_travel_together():
    random = np.random.default_rng(3)
    for most in (5, 4000):
        parts = {
            at: [np.sort(random.integers(0, 1 << 32, n, dtype=np.uint32)), random.integers(0, 9, n, dtype=np.uint8), random.integers(-9, 9, n // 2)]
            for at, n in ((0, most), (2, 1), (7, most // 2))
        }
        back = exchange.unpack_parts(exchange.pack_parts(parts))
        assert list(back) == [0, 2, 7]
        assert all(x.dtype == y.dtype and np.array_equal(x, y) for at in parts for x, y in zip(back[at], parts[at], strict=True))
