"""The pipeline's stages on the smallest tables and on awkward rows, against brute force."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import decontamination, line_dedup, packing, quality_classifier
from tallyweave.llm.queries import ORACLES, QUERIES
from tests.llm import plain

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
TABLES = ("documents", "benchmark", "labels", "pages", "conversations", "embeddings")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with awkward documents, where the classifier has something to learn."""
    at = str(tmp_path_factory.mktemp("tables"))
    good = [" ".join(plain.words(60, 900 + i)) + f"\nline {i} a\nline {i} b" for i in range(60)]
    bad = [" ".join(f"{w}!!" for w in plain.words(50, 2000 + i)) for i in range(20)]
    leak = " ".join(plain.words(30, 4000))
    texts = good + bad + [good[0], good[1].replace("w", "W", 3), f"{good[2]} {leak}", "alone\nline 3 a\nline 3 b", None, ""]
    table = plain.docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = table.where("doc_id < 80").select("doc_id", (F.col("doc_id") < 60).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_as_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = before, after
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        before = after

    before, after = kept["quality classifier"]
    ids = {r.doc_id for r in after.collect()}
    assert ids >= set(range(60)) and not ids & set(range(60, 80))

    before, after = kept["line dedup"]
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text").toArrow())
    report = {r[0]: r for r in con.execute(line_dedup.ORACLE).fetchall()}
    expected = [(i, sha) for i, lines, gone, _, sha in report.values() if not lines or gone < lines]
    plain.same(after.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), expected)
    assert after.where("n_chars <> length(text)").count() == 0

    before, after = kept["MinHash near-dedup"]
    expected = [(r["doc_id"],) for r in plain.components_of(before, k=5) if r["kept"]]
    plain.same(after.select("doc_id"), expected)
    assert after.count() < before.count()

    before, after = kept["benchmark decontamination"]
    con.register("documents", before.select("doc_id", "text").toArrow())
    con.register("benchmark", spark.read.parquet(f"{folder}/benchmark.parquet").toArrow())
    rows = con.execute(f"SELECT doc_id, contaminated FROM ({decontamination.ORACLE})").fetchall()
    plain.same(after.select("doc_id"), [(i,) for i, hit in rows if not hit])
    assert any(hit for _, hit in rows)

    before, after = kept["packing"]
    encoder = packing.public_encoder()
    sizes = {r.doc_id: len(encoder.exact.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    found = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert found == sizes


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    plain.same(got.select(*names), cursor.fetchall())


@needs_data
def test_queries_without_sql_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain.same(QUERIES["op2_suffix_repeats"](spark, DATA), plain.later_strings(docs))
    plain.same(QUERIES["op5_near_duplicates"](spark, DATA), plain.components_of(docs))
    plain.same(QUERIES["op8_block_anchors"](spark, DATA), plain.later_windows(docs))
    rules = QUERIES["op3_quality_rules"](spark, DATA).drop("distance")
    assert rules.count() == docs.count() and rules.where("kept <> (NOT base_failed AND NOT outlier)").count() == 0
    scores = QUERIES["op6_quality_classifier"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = scores.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.8
    assert scores.where(f"predicted <> cast(score >= {quality_classifier.THRESHOLD} AS int)").count() == 0
    packed = QUERIES["op7_packing"](spark, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()
