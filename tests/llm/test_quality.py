"""Quality rules and the quality classifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import quality_classifier, quality_rules
from tests.llm import plain


def test_base_counts_as_brute_force(spark):
    table = plain.documents_of(spark)
    got = quality_rules.base_counts(table).select("doc_id", *quality_rules.BASE, "base_failed")
    expected = []
    for r in table.collect():
        c = plain.word_statistics(r.text)
        expected.append((r.doc_id, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    plain.same(got, expected)


def ordinary(n, seed, noise=0.0):
    random = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        w = [f"{'abcdefghij'[int(x) % 10] * int(1 + x % 9)}" for x in random.integers(0, 1000, int(random.integers(40, 400)))]
        if random.random() < noise:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
    return texts


def numpy_mcd(x, noise, rule):
    """The same concentration steps on one group, with plain numpy; returns distances."""
    cut = quality_rules.chi_square_at(rule.coverage, quality_rules.DIM)
    scale = rule.coverage / quality_rules.chi_square(cut, quality_rules.DIM + 2)
    usual, ordered, best = noise.mean(0), np.sort(x, 0), None
    low, middle, high = (ordered[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.5, 0.75))
    near = (x - middle) ** 2
    for d in (np.zeros(len(x)), (near / usual).sum(1), (near / ((high - low) ** 2 + usual)).sum(1)):
        for _ in range(rule.steps):
            most = np.sort(d)[int(np.ceil(rule.coverage * len(x))) - 1]
            inner = x[d <= most]
            centre, spread = inner.mean(0), np.cov(inner.T, bias=True) * scale + np.diag(usual)
            away = x - centre
            d = np.einsum("ij,jk,ik->i", away, np.linalg.inv(spread), away)
        det = np.linalg.slogdet(spread)[1]
        if best is None or det < best[0] - 1e-12:
            variances = np.diag(spread)
            own = away * np.sqrt(variances / (variances + np.maximum(noise - usual, 0)))
            best = (det, np.sqrt(np.einsum("ij,jk,ik->i", own, np.linalg.inv(spread), own)))
    return best[1]


def test_outliers_as_numpy(spark):
    rule = quality_rules.Rule(min_group=30)
    table = plain.docs(spark, ordinary(240, 5, noise=0.08)).withColumns({"lang": F.lit("en"), "source": F.lit("x")})
    judged = quality_rules.judge(quality_rules.base_counts(table), rule).collect()
    x, noise = [], []
    for r in judged:
        w, c = max(1, r.n_words), max(1, r.word_chars)
        x.append([np.log1p(w), np.log(c / w), *np.sqrt([r.n_symbols / c, r.n_dup_lines / w, r.n_repeat_words / w])])
        noise.append([1 / w, 1 / c, 0.25 / c, 0.25 / w, 2.5 / w])
    expected = numpy_mcd(np.array(x), np.array(noise), rule)
    assert np.allclose([r.distance for r in judged], expected, rtol=1e-6)
    noisy = np.array([r.n_symbols > 0 for r in judged])
    out = np.array([r.outlier for r in judged])
    assert noisy.sum() > 5 and out[noisy].all() and not out[~noisy].any()


def counted(spark, rows):
    """Rows of base counts from (source, words, word length, symbols)."""
    return spark.createDataFrame(
        [(i, "en", s, int(w), int(w * m), int(y), 0, 0, False) for i, (s, w, m, y) in enumerate(rows)],
        "doc_id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint, base_failed boolean",
    )


def outliers(table):
    return {r.doc_id for r in quality_rules.judge(table).where("outlier").collect()}


def test_the_same_text_is_judged_by_its_group(spark):
    random = np.random.default_rng(8)
    even = [("even", w, 5, 0) for w in random.integers(300, 900, 200)]
    mixed = [("mixed", w, 5, w * 5 * random.uniform(0, 0.3)) for w in random.integers(300, 900, 200)]
    text = (600, 5, 450)
    table = counted(spark, [("even", *text), ("mixed", *text), *even, *mixed])
    assert outliers(table) == {0}


def test_correlated_statistics_reject_together(spark):
    random = np.random.default_rng(9)
    u = random.normal(0, 1, 400)

    def made(u, v):
        return "x", round(np.exp(6 + 0.8 * u)), np.exp(1.7 + 0.3 * v), 0

    usual = [made(a, a + random.normal(0, 0.05)) for a in u]
    # Both statistics are common by themselves: the first two texts go along with the rest.
    table = counted(spark, [made(2, 2), made(-2, -2), made(2, -2), made(-2, 2), *usual])
    assert outliers(table) == {2, 3}


def test_short_texts_are_judged_by_their_own_uncertainty(spark):
    random = np.random.default_rng(10)
    usual = [("x", w, 5, 0) for w in np.exp(random.normal(5.5, 1, 300)).clip(20, 3000)]
    # Half again the usual mean length: possible in fourteen words, not in six hundred.
    assert outliers(counted(spark, [("x", 14, 7.5, 0), ("x", 600, 7.5, 0), *usual])) == {1}


def test_small_groups_are_pooled_and_nulls_are_groups(spark):
    table = plain.documents_of(spark)
    judged = quality_rules.apply(table)
    assert judged.count() == table.count()
    # Too few rows for any estimate: only the base rule rejects.
    assert judged.where("outlier OR kept = base_failed").count() == 0
    texts = plain.docs(spark, ordinary(200, 6))
    pooled = quality_rules.apply(texts, quality_rules.Rule(min_group=50))
    assert pooled.where("distance IS NULL").count() == 0
    assert {r.grp for r in pooled.select("grp").distinct().collect()} == {
        '{"pool":1,"lang":"en"}', '{"pool":1,"lang":"de"}', '{"pool":1}'
    }


def test_chi_square_quantiles():
    assert abs(quality_rules.chi_square_at(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality_rules.chi_square_at(0.5, 2) - 1.386294) < 1e-5


@pytest.fixture(scope="module")
def labelled(spark):
    good, bad = ordinary(300, 1), [" ".join(f"{x}!!" for x in t.split()) for t in ordinary(60, 2)]
    table = plain.docs(spark, good + bad)
    labels = table.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("quality"))
    return table, labels


def test_held_out_accuracy_and_unseen_labels(spark, labelled):
    table, labels = labelled
    got = quality_classifier.classify(table, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.where("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert held.count() > 40 and right > 0.95
    # Held-out labels have no part: turned round, nothing changes.
    turned = labels.withColumn("quality", F.when(quality_classifier.remainder() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality_classifier.classify(table, turned).collect()) == sorted(got.collect())


def test_scores_are_sparse_dot_products(spark, labelled):
    table, _ = labelled
    weights = np.random.default_rng(0).normal(size=quality_classifier.BUCKETS + 1).astype(np.float32)
    for r in quality_classifier.score(table.limit(20), weights).collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        _, buckets, values = quality_classifier.features(raw, np.array([0, len(raw)]))
        assert abs((values**2).sum() - 1) < 1e-9
        expected = 1 / (1 + np.exp(-(float(values @ weights[buckets].astype(float)) + float(weights[-1]))))
        assert abs(r.score - expected) < 1e-9


def test_updates_are_ftrl_proximal():
    """The vectorised updates against the textbook's loop over coordinates."""
    examples = [(np.array([1, 5]), np.array([0.6, 0.8]), 1), (np.array([5, 9]), np.array([0.8, 0.6]), 0), (np.array([1]), np.array([1.0]), 1)]
    setting = quality_classifier.Ftrl()
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= setting.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * setting.l1) / ((setting.beta + n[i] ** 0.5) / setting.alpha + setting.l2)

    for _ in range(quality_classifier.EPOCHS):
        for at, x, y in examples:
            pairs = [*zip(at.tolist(), x.tolist()), (quality_classifier.BUCKETS, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / setting.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality_classifier.fit(examples)
    for i in (1, 5, 9, quality_classifier.BUCKETS):
        assert abs(got[i] - weight(i)) < 1e-12


def test_awkward_rows_and_the_sample_bound(spark, labelled):
    table, labels = labelled
    weights = quality_classifier.train(table, labels, max_sample=50)
    assert len(weights) == quality_classifier.BUCKETS + 1
    odd = plain.documents_of(spark)
    scored = quality_classifier.score(odd, weights)
    # The column named like the result is replaced, all others stay.
    assert scored.count() == odd.count() and sorted(scored.columns) == sorted(odd.columns)
    assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = quality_classifier.accept(odd, labels)
    assert kept.schema == odd.schema
    unlabelled = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    assert {r.score for r in quality_classifier.classify(odd, unlabelled).collect()} == {0.5}


@pytest.mark.parametrize("rows", ["documents", "labels", "both"])
def test_empty_tables(spark, labelled, rows):
    table, labels = labelled
    empty = table.limit(0), labels.limit(0)
    docs = empty[0] if rows != "labels" else table
    known = empty[1] if rows != "documents" else labels
    assert quality_classifier.classify(docs, known).count() == docs.count()
    if rows == "documents":
        assert quality_rules.apply(docs).count() == 0
