"""Packing and chat formatting: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyweave.llm import chat_format, packing
from tests.llm import plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 40))
def test_tree_finds_the_first_sequence_with_room(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    where, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), capacity)
    room: list[int] = []
    for n, w, o in zip(lengths, where, offset):
        first = next((i for i, left in enumerate(room) if left >= n), len(room))
        if first == len(room):
            room.append(capacity)
        assert (w, o) == (first, capacity - room[first])
        room[first] -= n


def test_every_id_lies_in_one_piece(spark):
    table = plain.documents_of(spark)
    packed = packing.pack_documents(table).toPandas()
    encoder = packing.public_encoder()
    for r in table.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL").collect():
        ids = np.array([*encoder.exact.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = packed[packed.doc_id == r.doc_id].drop_duplicates("start").sort_values("start")
        assert mine.start.tolist() == list(range(0, len(ids), 2048)) and (mine.doc_tokens == len(ids)).all()
        for start, length, crc in zip(mine.start, mine.length, mine.ids_crc32):
            assert length <= 2048 and crc == zlib.crc32(ids[start : start + length].tobytes())
    # A row given twice is packed twice.
    assert (packed.doc_id == 9).sum() == 2
    for _, sequence in packed.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]] and sequence.length.sum() <= 2048


def test_little_padding_whatever_the_partitions(spark):
    texts = [" ".join(plain.words(int(n), i)) for i, n in enumerate(np.random.default_rng(2).integers(5, 600, 400))]
    table = plain.docs(spark, texts)
    one = packing.pack_documents(table.coalesce(1)).toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True)
    many = packing.pack_documents(table.repartition(7)).toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True)
    assert one.equals(many)
    assert one.length.sum() / (one.sequence_id.nunique() * 2048) > 0.98
    groups = packing.pack(packing.pieces(table), group_pieces=100).toPandas()
    assert len(groups) == len(one) and (groups.sequence_id // 2**32).nunique() >= 4


def test_both_tokenizers_give_the_same_ids():
    encoder = packing.public_encoder()
    for c in map(chr, range(0x250)):
        for t in (f"a{c}b {c} {c}{c}1{c}\n{c}", c, f" {c}x", f"x  {c}  y{c}\t{c}'s 12{c}34", f"\n\n{c}\n \n"):
            assert encoder(t, True) == encoder(t, False)
    # Special strings are read as the tokenizer file reads them.
    for mark in encoder.marks:
        assert encoder(f"a {mark} b", True) == encoder.exact.encode(f"a {mark} b", add_special_tokens=False).ids


TEXTS = st.lists(st.sampled_from([*"ab<|\\>\nimstrd_ é", "<|im_end|>", "<|im_start|>", chat_format.PROBE]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_turns_come_back(turns):
    assert chat_format.read_back(chat_format.marked_template(turns)) == turns
    for _, text in turns:
        assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\\nb\n"]), TEXTS), max_size=5))
def test_spans_are_those_of_the_template(turns):
    made = chat_format.render_incrementally(turns, chat_format.marked_template)
    assert made.rewrites_at is None and made.formatted == chat_format.marked_template(turns)
    for (role, text), (a, b), (c, d) in zip(turns, made.turns, made.texts):
        assert made.formatted[a:b] == chat_format.marked_template([(role, text)])
        assert chat_format.unescape(made.formatted[c:d]) == text


def test_templates_that_rewrite_history_are_detected():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]

    def hides_earlier_answers(given):
        last = max((i for i, (role, _) in enumerate(given) if role == "user"), default=0)
        return "".join(f"[{r}]{t if r == 'user' or i > last else ''};" for i, (r, t) in enumerate(given))

    assert chat_format.render_incrementally(turns, hides_earlier_answers).rewrites_at == 2
    counted = lambda given: f"{len(given)} turns: " + " ".join(t for _, t in given)
    made = chat_format.render_incrementally(turns, counted)
    assert made.rewrites_at == 0 and not made.texts and made.formatted == counted(turns)
    stripped = lambda given: "".join(f"<{r}>{t.strip()}</{r}>" for r, t in given)
    made = chat_format.render_incrementally([("user", " a "), ("assistant", "b")], stripped)
    assert [made.formatted[a:b] for a, b in made.texts] == ["a", "b"]


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|> \\"), (1, 2, "assistant", ""), (2, 0, None, None), (3, 1, "assistant", "é"),
    (3, None, "user", "first"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "tie"), (None, 0, "assistant", "no id"),
]


def conversations(spark):
    rows = [(*r, "x", "y") for r in CONVERSATIONS]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string, loss string")


def test_conversations_as_sql(spark):
    table = conversations(spark)
    both = table.select("conv_id", "turn", "role", "text").unionByName(chat_format.control_conversation(table))
    got = chat_format.digests(chat_format.format_conversations(both))
    plain.same_as_sql(got, chat_format.ORACLE, conversations=table.select("conv_id", "turn", "role", "text"))
    control = got.where("conv_id = -1").first()
    assert control.n_turns == 2 and control.loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_long_conversations_and_partitions(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (50 if c == 7 else 1)) for c in range(40) for t in range(60 if c == 7 else 4)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(9)
    got = chat_format.digests(chat_format.format_conversations(table))
    plain.same_as_sql(got.where("conv_id >= 0"), chat_format.ORACLE + " HAVING conv_id >= 0", conversations=table)


def test_rewriting_templates_have_no_loss(spark):
    made = chat_format.format_conversations(conversations(spark), lambda turns: f"{len(turns)}" + "".join(t for _, t in turns))
    assert made.where("rewrites_at IS NULL OR size(loss) > 0").count() == 0


@pytest.mark.parametrize("name", ["packing", "chat"])
def test_empty_table(spark, name):
    if name == "packing":
        assert packing.pack_documents(spark.createDataFrame([], plain.DOCS)).count() == 0
    else:
        assert chat_format.format_conversations(conversations(spark).limit(0)).count() == 0
