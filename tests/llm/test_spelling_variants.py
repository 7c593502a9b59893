"""Spelling variants: the composed acceptor, its partitions, and the whole query by brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tallyweave.llm import spelling_variants as sv
from tests.llm import plain


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def shared(u, v):
    return next((i for i, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v)))


def arrays(words):
    words = np.sort(np.array(list(words), dtype=f"<U{sv.LONGEST}"))
    symbols = words.view(np.uint32).reshape(len(words), -1)
    return words, symbols, (symbols != 0).sum(1)


def some_words(r, letters, longest, n):
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(r.randint(1, n))}


@pytest.mark.parametrize("seed", range(40))
def test_composition_as_brute_force(seed):
    r = random.Random(seed)
    words, symbols, lengths = arrays(some_words(r, "abcdé"[: r.choice([2, 3, 5])], 8, 80))
    depth = r.randint(0, 3)
    one, two = sv.near_ranks(symbols, lengths, np.full(len(words), depth))
    got = sorted(tuple(sorted((words[i], words[j]))) for i, j in zip(one, two))
    pairs = itertools.combinations([str(w) for w in words], 2)
    assert got == sorted(p for p in pairs if near(*p) and shared(*p) >= depth)


def test_the_acceptor_is_minimal_and_accepts_its_words():
    words, symbols, lengths = arrays(some_words(random.Random(5), "abc", 6, 200))
    a = sv.acceptor(symbols, lengths)
    root = a.node_state[0]

    def language(state, before=""):
        found = [before] if a.accepting[state] else []
        for arc in range(a.first[state], a.first[state + 1]):
            found += language(a.to[arc], before + chr(a.label[arc]))
        return found

    assert language(root) == list(words)
    rights = [tuple(language(s)) for s in range(len(a.size))]
    assert len(set(rights)) == len(rights)
    assert [len(x) for x in rights] == list(a.size)


@pytest.mark.parametrize("limit", [3, 20, 10_000])
def test_partitions_lose_no_pair(spark, limit):
    r = random.Random(limit)
    words = some_words(r, "aaaab", 9, 300) | some_words(r, "abcdeé", 7, 300) | {"a" * k for k in range(1, 30)}
    words |= {"q" * 62 + x for x in ("", "a", "ab", "abc", "abcd", "abce", "bbcd", "abcde", "ab" * 50, "ab" * 49 + "b")}
    words |= {"a" * 3_000, "a" * 2_999, "a" * 1_500 + "b" + "a" * 1_499}
    table = spark.createDataFrame([(w, len(w) + 1) for w in words], "word string, n bigint")
    got = sorted((x.word, x.near, x.near_n) for x in sv.near_words(table, limit).collect())
    assert got == sorted((u, v, len(v) + 1) for u in words for v in words if near(u, v))


def brute_force(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain.A_TO_Z)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= 2 and len(w) >= 7}
    form, count = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    result = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return result


@pytest.mark.parametrize("limit", [7, sv.LIMIT])
def test_variants_as_brute_force(spark, limit):
    r = random.Random(9)
    base = ["".join(r.choice("aeinrstÉ") for _ in range(r.randint(6, 10))) for _ in range(25)]
    base += ["Straßenname", "Überfülle", "aaaaaaaa", "aaaaaaab", "x×÷yzabc", "hyphenated-wordings"]
    texts = plain.awkward_texts() + [" ".join(r.choices(base, k=400)) for _ in range(20)]
    # A chain of forms, each ten times as frequent; ties of counts; very long words.
    texts += ["chainabcd " * 3, "chainabc " * 40, "chainab xxchainab " * 500, "tiedworda " * 30 + "tiedwordb " * 30 + "tiedwordc " * 2]
    texts += ["z" * 200_000 + " " + "z" * 199_999, "z" * 200_000 + " " + "z" * 199_999, None, ""]
    table = plain.docs(spark, texts).unionByName(plain.documents_of(spark))
    got = sv.variants(table, limit)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    expected = brute_force([(x.doc_id, x.text) for x in table.collect()])
    assert any(e[1] and e[2] != e[1] for e in expected)
    plain.same(got, expected)


def test_empty_table(spark):
    assert sv.variants(plain.docs(spark, [])).count() == 0
    assert sv.variants(plain.docs(spark, [None, "", "short ones"])).count() == 0
