"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

Every run of `window` consecutive words of a benchmark item (or the whole item, if it is shorter)
is a set of shingles with known places. Containment must be complete, so the prefix that has to
be joined is one shingle: the one rarest over all documents. Its place in the window gives the
start the window would have in the document, which bounds the other shingles' places; each of
them is then required exactly there. Shingles are compared as text, so no hash decides a result.

Words are maximal runs of characters other than ASCII marks, blanks and controls, with A-Z
lowered. Null texts and texts without words hold no window and contain none. Repeated benchmark
items are one window set with several ids; repeated documents are each reported. Documents with
one id and different texts are kept apart by their texts. Further columns are ignored, whatever
their names are. Empty tables give clean documents or no rows.

Benchmark shingles are broadcast while their measured number is below a bound; beyond it, the
same joins run as shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import free_name
from tallyweave.session import pin

WINDOW = 10
SHINGLE = 3
# A shingle row is about 60 bytes, so a broadcast stays near 12 MB.
BROADCAST_SHINGLES = 200_000
_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.split(F.coalesce(lowered, F.lit("")), _MARKS)
    return F.array_remove(cut, "")


def _shingles(words: Column, k: int) -> Column:
    """Every run of k words as text, in order; empty for fewer words."""
    last = F.size(words) - k
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]),
        )
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, window text and number of words of every distinct window of every item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    wins = words.select("item", size.alias("len"), F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " ")).alias("wins"))
    return wins.select("item", "len", F.explode("wins").alias("win")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """win, len, k, off, shingle: the shingles of every distinct window with their places."""
    wins = windows.select("win", "len").distinct().withColumn("words", F.split("win", " "))
    parts = None
    for k in range(1, shingle + 1):
        # Windows of fewer words than a shingle are one shingle of their own length.
        own = wins.where(F.col("len") == k) if k < shingle else wins.where(F.col("len") >= k)
        part = own.select("win", "len", F.lit(k).alias("k"), F.posexplode(_shingles(F.col("words"), k)).alias("off", "shingle"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _row_key() -> Column:
    """Names a document row; equal rows share a key and a result."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """row_key, start, len, win: every place where a benchmark window occurs in a document."""
    shingles = pin(window_shingles(benchmark_windows(benchmark, window), shingle))
    traits = shingles.groupBy("k").count().collect()  # at most `shingle` rows
    small = sum(r["count"] for r in traits) <= BROADCAST_SHINGLES

    listed = shingles.select("shingle").distinct()
    words = docs.select(_row_key().alias("row_key"), words_of(F.col("text")).alias("words"))
    found = None
    for k in sorted(r["k"] for r in traits) or [shingle]:
        part = words.select("row_key", F.posexplode(_shingles(F.col("words"), k)).alias("pos", "shingle"))
        part = part.join(_bounded(listed, small), "shingle").select("row_key", F.lit(k).alias("k"), "pos", "shingle")
        found = part if found is None else found.unionByName(part)
    found = pin(found)

    rarity = found.groupBy("k", "shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(rarity, ["k", "shingle"], "left")
    # A window with a shingle that no document holds occurs nowhere.
    prefix = ranked.groupBy("win", "len", "k").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "off", "shingle")).alias("p"), F.count("*").alias("need")
    )
    prefix = pin(prefix.where("least > 0").select("win", "len", "k", "need", F.col("p.off").alias("off"), F.col("p.shingle").alias("shingle")))
    likely = found.join(_bounded(prefix, small), ["k", "shingle"])
    likely = likely.select("row_key", (F.col("pos") - F.col("off")).alias("start"), "win", "len", "k", "need").where("start >= 0").distinct()

    places = likely.join(_bounded(shingles.select("win", "off", "shingle"), small), "win")
    places = places.select("row_key", "start", "win", "len", "need", "k", (F.col("start") + F.col("off")).alias("pos"), "shingle")
    held = places.join(found.distinct(), ["row_key", "k", "pos", "shingle"])
    full = held.groupBy("row_key", "start", "win", "len", "need").agg(F.count("*").alias("n")).where("n = need")
    return full.select("row_key", "start", "len", "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Words, hit words, and the items with occurring windows, per document."""
    hits = pin(matches(docs, benchmark, window, shingle))
    hit_words = (
        hits.select("row_key", "start", "len").distinct()
        .select("row_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
        .distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    )
    windows = benchmark_windows(benchmark, window).select("item", "win")
    items = (
        hits.select("row_key", "win").distinct().join(windows, "win").select("row_key", "item").distinct()
        .groupBy("row_key").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))
    )
    found = hit_words.join(items, "row_key", "left")
    rows = docs.select("doc_id", _row_key().alias("row_key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    none = F.lit(0).cast("bigint")
    return rows.join(found, "row_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    name = free_name(docs, "hit")
    hit = matches(docs, benchmark, window, shingle).select(F.col("row_key").alias(name)).distinct()
    return docs.join(hit, _row_key() == F.col(name), "left_anti")


# Independent of the operator: all windows of all documents against all windows of all items.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT cast(item_id AS varchar) AS item, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS m,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
      lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win
  FROM iw WHERE len(w) > 0),
places AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w
  FROM dw, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m),
hits AS (
  SELECT p.doc_id, p.i, p.m, s.item FROM places p
  JOIN wins s ON s.m = p.m AND s.win = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
words AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT doc_id, i, m FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
