"""Language identification: the kernel and the features by brute force, and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import language_id as li
from tests.llm import plain

TEXTS = ["Ein Text", "ein  TEXT!", "naïve Café", "x", "", None, "1234 %%", "abc" * 50, "ΑΒΓ δέλτα", "İstanbul ab\x00cd 9z"]


def grams(text, longest=4):
    shown = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    if not shown.strip():
        return set()
    return {shown[i : i + n] for n in range(1, longest + 1) for i in range(len(shown) - n + 1)}


@pytest.mark.parametrize("points", [3, 7, 1 << 20])
def test_presence_is_that_of_gram_sets(monkeypatch, points):
    monkeypatch.setattr(li, "POINTS", points)
    # Combining marks are no letters; `\w` and isalpha agree on these texts.
    texts = [t for t in TEXTS if t is None or "İ" not in t]
    rows, wordy = li.presence(texts)
    sets = [grams(t) for t in texts]
    assert list(wordy) == [bool(s) for s in sets]
    assert [int(x) for x in rows.sum(1)] == [len(s) for s in sets]
    shared = [[len(a & b) for b in sets] for a in sets]
    assert (rows @ rows.T == np.array(shared)).all()
    both = np.array([[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    assert np.allclose(li.kernel(rows, rows), both, atol=1e-6)


def some_texts(n, seed, words=(5, 80)):
    r = np.random.default_rng(seed)
    alphabets = {"aa": ["ba", "na", "to", "ri"], "bb": ["sch", "ein", "ung", "to"], "cc": ["éa", "ri", "oux", "ne"]}
    rows = []
    for i in range(n):
        lang = ("aa", "aa", "aa", "bb", "bb", "cc")[i % 6]
        rows.append((lang, " ".join("".join(r.choice(alphabets[lang], r.integers(1, 4))) for _ in range(r.integers(*words)))))
    return rows


def test_nystrom_ridge_is_the_kernel_solution_and_folds():
    rows = some_texts(60, 1)
    x, _ = li.presence([t for _, t in rows])
    languages = np.array([g for g, _ in rows], object)
    # With every text a landmark, Nyström features give exactly kernel ridge regression.
    names, marks, weights, bias = li.fit(np.packbits(x > 0, axis=1), languages, li.Kernel(landmarks=60, ridge=0.01))
    k = li.kernel(x, x).astype(float)
    count = np.array([1 / (languages == g).sum() / 3 for g in languages])
    wanted = np.where(languages[:, None] == np.array(names)[None], 1.0, -1.0)
    centre = np.eye(60) - np.outer(np.ones(60), count)
    inner = centre @ k @ centre.T
    dual = np.linalg.solve(inner * count[None, :] + 0.01 * np.eye(60), wanted - count @ wanted)
    expected = inner @ (count[:, None] * dual) + count @ wanted
    assert np.allclose(li.kernel(x, marks) @ weights + bias, expected, atol=1e-4)
    slots = (marks / np.sqrt(marks.sum(1))[:, None]).T @ weights.astype(np.float32)
    assert np.allclose(li.Model(names, slots, bias).values(x), expected, atol=1e-4)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_languages(spark):
    rows = some_texts(600, 2) + [("aa", None), ("bb", ""), ("cc", "12 34"), (None, "bana tori")]
    table = plain.docs(spark, [t for _, t in rows])
    langs = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], "doc_id bigint, true string")
    docs = table.join(langs, "doc_id").withColumn("lang", F.col("true")).drop("true")
    got = {r.doc_id: r for r in li.identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == held_out(i) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    tested = [(got[i].lang_pred, g) for i, (g, _) in enumerate(rows[:600]) if held_out(i)]
    assert len(tested) > 100 and sum(a == b for a, b in tested) >= 0.99 * len(tested)
    assert [got[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and got[600].score == 0
    # Languages, sources and ids of held-out rows change nothing.
    odd = docs.withColumn("lang", F.when(li.remainder() == 2, F.lit("zz")).otherwise(F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in li.identify(odd).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_the_sample_is_bounded_and_whole_when_small(spark):
    rows = some_texts(300, 3)
    table = plain.docs(spark, [t for _, t in rows]).withColumn("lang", F.lit("en"))
    table = table.unionByName(table.where("doc_id = 1").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("x"))
    model = li.train(table, li.Kernel(sample=50, landmarks=10))
    assert model.languages == ["en"]
    assert all(r.lang_pred in ("en", "und") for r in li.predict(table, model).collect())


def test_awkward_and_empty_tables(spark):
    table = plain.documents_of(spark)
    got = li.identify(table)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = got.collect()
    assert len(rows) == table.count()
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {0, 1, 2, 100}
    assert li.identify(plain.docs(spark, [])).count() == 0
    nothing = li.identify(plain.docs(spark, ["some words"]).withColumn("lang", F.lit(None).cast("string")))
    assert [(r.lang_pred, r.score) for r in nothing.collect()] == [("und", 0.0)]
    kept = li.predict(table.withColumnRenamed("hit", "lang_pred"), li.train(table))
    assert kept.columns == [c for c in table.columns if c not in ("hit", "score")] + ["lang_pred", "score"]
