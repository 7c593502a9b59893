"""URL filters and benchmark decontamination against SQL and brute force."""

import re

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, url_filters
from tests.llm import plain

URLS = [
    "http://www.Example.ORG/es/a", "https://example.org/en/1?x=1", "https://example.org/en/2", "http://notexample.org/en/1",
    "http://shop.com/fr/x#top", "http://com/de/", "http://a.b.com/de", "HTTP://x.net/p.html?utm_source=q&b=2&a=1#f",
    "https://x.net/p/?a=1&ref=z&b=2", "http://x.net/p?b=2&a=1", "ftp://", "no scheme", "", None, "http://org", "http://org/",
    "a://b://c.org/d", "http://x.net?q", "http://x.net", "http://www.x.net/#", "http://user@host:80/p", "http://ex ample.com/fr/\nnew",
]


def pages(spark):
    rows = [(i, u, "plain", "h", "b") for i, u in enumerate(URLS)]
    rows += [(100, "http://x.net/p?a=1&b=2", "noise ### here", "h", "b"), (101, "http://shop.com/fr/x", "$$$", "h", "b"),
             (102, None, "***", "h", "b"), (103, "http://com/de/", None, "h", "b"), (9, URLS[9], "plain", "h", "b")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, canonical string")


def test_urls_as_sql(spark):
    table = pages(spark).dropDuplicates(["page_id"])
    got = url_filters.judge(table, url_filters.noisy_urls(table))
    plain.same_as_sql(got, url_filters.ORACLE, pages=table.select("page_id", "url", "html"))


def judged(url, rules=url_filters.RULES):
    """Host, path and the longest rule, by plain string work."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(plain.A_TO_Z)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(str(r)), default=None)
    return host, path, rule


def test_rules_as_brute_force(spark):
    table = pages(spark)
    for r in url_filters.judge(table, url_filters.noisy_urls(table)).join(table.select("page_id", "url"), "page_id").collect():
        host, path, rule = judged(r.url)
        assert (r.host, r.path, r.rule) == (host, path, str(rule) if rule else None), r
        if rule:
            assert r.verdict == rule.verdict


def test_filter_has_no_false_negatives_and_the_join_no_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h"), "id", F.lit(".net/a")).alias("url"))
    urls = url_filters.listed_urls(listed)
    table = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".net/a")).alias("url"))
    got = url_filters.judge(table, urls)
    assert got.where("listed <> (page_id < 3000)").count() == 0
    filled, blocks = url_filters.bloom_filter(urls, 3000)
    assert blocks == 128 and filled.count() <= blocks
    # The filter alone lets few of the others pass.
    rows = table.select(F.regexp_replace("url", "http://", "").alias("canonical"), "page_id").withColumn("block", url_filters._block(blocks))
    rows = rows.join(filled, "block")
    for i in range(url_filters.WORDS):
        rows = rows.where(F.col(f"w{i}").bitwiseAND(url_filters._bit(i)) != 0)
    assert rows.where("page_id < 3000").count() == 3000 and rows.where("page_id >= 3000").count() < 200


def test_large_filters_are_joined_by_block(spark, monkeypatch):
    table = pages(spark)
    expected = sorted(url_filters.judge(table, url_filters.noisy_urls(table)).collect())
    monkeypatch.setattr(url_filters, "BROADCAST_BLOCKS", 0)
    assert sorted(url_filters.judge(table, url_filters.noisy_urls(table)).collect()) == expected


def test_empty_url_tables(spark):
    table = pages(spark)
    assert url_filters.judge(table.limit(0), url_filters.noisy_urls(table)).count() == 0
    unlisted = url_filters.judge(table, url_filters.noisy_urls(table.limit(0)))
    assert unlisted.count() == table.count() and unlisted.where("listed").count() == 0


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, "one"), (4, None), (5, "..."),
    (6, "three word item"), (10, "SHORT, item!"), (7, "rep rep rep rep rep rep rep rep rep rep rep rep"),
    (8, "é ü ß ñ 1 2 3 4 5 6 7"), (1, "another text under the first id with more than ten words in it"),
]
BODIES = [
    "x alpha beta gamma delta epsilon zeta eta theta iota kappa y", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu",
    "alpha beta gamma delta epsilon zeta eta theta iota", "a Short-Item b short  item", "onetwo three", "some one", None, "", " . ",
    "rep " * 25, "three word items", "É é ü ß ñ 1 2 3 4 5 6 7 8", "the three word item and three, WORD item",
    "ANOTHER text under the first id with more than ten words in it", "alpha " * 9 + "beta gamma",
]


def brute(table, items, window=10):
    wins = {}
    for item, text in items:
        w = plain.CLEAN_WORD.findall((text or "").translate(plain.A_TO_Z))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for r in table.collect():
        w = plain.CLEAN_WORD.findall((r.text or "").translate(plain.A_TO_Z))
        hit, found = set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[tuple(w[i : i + size])]
        out.append((r.doc_id, len(w), len(hit), len(found), plain.sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaked(spark):
    table = plain.docs(spark, BODIES)
    items = spark.createDataFrame([(*i, "row_key", "win") for i in ITEMS], "item_id bigint, text string, row_key string, win string")
    # Rows of one id with different texts, a repeated row, and a row without an id.
    table = table.unionByName(table.where("doc_id = 0")).unionByName(table.where("doc_id = 1").withColumn("doc_id", F.lit(0).cast("bigint")))
    return table.unionByName(table.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("bigint"))), items


def test_leaks_as_brute_force(leaked):
    table, items = leaked
    plain.same(decontamination.decontaminate(table, items), brute(table, ITEMS))


def test_leaks_as_sql(spark, leaked):
    table, items = leaked
    table = table.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plain.same_as_sql(
        decontamination.decontaminate(table, items), decontamination.ORACLE,
        documents=table.select("doc_id", "text"), benchmark=items.select("item_id", "text"),
    )


def test_large_benchmarks_are_shuffled(leaked, monkeypatch):
    table, items = leaked
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    plain.same(decontamination.decontaminate(table, items), brute(table, ITEMS))


def test_clean_documents_stay(leaked):
    table, items = leaked
    kept = decontamination.clean(table, items)
    assert kept.schema == table.schema
    clean = [r[0] for r in brute(table, ITEMS) if not r[5]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)


def test_only_dataframe_functions(spark, leaked):
    table, items = leaked
    for got in (decontamination.decontaminate(table, items), url_filters.judge(pages(spark), url_filters.noisy_urls(pages(spark)))):
        assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_empty_tables(leaked):
    table, items = leaked
    assert decontamination.decontaminate(table.limit(0), items).count() == 0
    none = decontamination.decontaminate(table, items.limit(0))
    assert none.count() == table.count() and none.where("contaminated").count() == 0
    assert decontamination.clean(table, items.limit(0)).count() == table.count()
