"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

The list is made of canonical URLs. Each sets one bit in each of the eight words of one block of
the filter; a page's URL whose bits are all set is a possible hit and goes to an exact join with
the list, which removes the false ones. Only possible hits are shuffled. Blocks are a table, so
the filter is broadcast while its measured size is small and joined by block number beyond that.

A URL's host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lowered;
its path follows up to `?`, `#` or the end. Without `://`, or for null, both are empty, no rule
fits and nothing is listed. Repeated URLs and list entries do not change results. Columns with
the names of result columns are replaced, other columns are ignored. An empty list blocks nothing.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.session import pin

WORDS = 8
BITS_PER_URL = 12
# A block is 8 words and its number: about 100 bytes in a broadcast table, 26 MB in all.
BROADCAST_BLOCKS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(urls: DataFrame) -> DataFrame:
    """Add host and path to a table with a column url."""
    rest = F.expr("CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return urls.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def canonical(urls: DataFrame) -> Column:
    """Canonical form: no scheme, `www.`, fragment, tracking parameters, `.html` or last slash.

    Null for a URL without a host. `urls` has host, path and url.
    """
    query = F.regexp_extract(F.col("url"), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))
    path = F.regexp_replace(F.regexp_replace("path", r"\.html$", ""), "/+$", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(kept), "&"))).otherwise("")
    return F.when(F.col("host") != "", F.concat(F.regexp_replace("host", r"^www\.", ""), path, tail))


def matching_rule(rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits host and path, as struct<rule, verdict>; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last branch is tried first.
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        named = F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


def _bit(word: int) -> Column:
    """A value with the one bit that a URL sets in a word."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(9, canonical), {6 * word}) & 63L AS int))")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(8), F.col("canonical")), F.lit(blocks))


def bloom_filter(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Blocks of the filter over a column canonical of `count` rows, and their number."""
    blocks = 1
    while blocks * 64 * WORDS < BITS_PER_URL * count:
        blocks *= 2
    words = [F.bit_or(_bit(i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(blocks).alias("block")).agg(*words), blocks


def listed_urls(urls: DataFrame) -> DataFrame:
    """Distinct canonical URLs of a table with a column url."""
    named = host_and_path(urls.select("url"))
    return named.select(canonical(named).alias("canonical")).where("canonical IS NOT NULL").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages.

    `listed` has distinct canonical URLs in a column canonical; they are blocked unless a rule
    decides.
    """
    listed = pin(listed)
    filled, blocks = bloom_filter(listed, listed.count())
    rows = host_and_path(pages.select("page_id", "url"))
    rows = rows.withColumn("canonical", canonical(rows)).withColumn("block", _block(blocks))
    if blocks <= BROADCAST_BLOCKS:
        filled = F.broadcast(filled)
    rows = rows.join(filled, "block", "left")
    possible = F.col("canonical").isNotNull()
    for i in range(WORDS):
        possible = possible & (F.col(f"w{i}").bitwiseAND(_bit(i)) != 0)
    rows = rows.select("page_id", "host", "path", "canonical", F.coalesce(possible, F.lit(False)).alias("possible"))
    hits = rows.where("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    missed = rows.where("NOT possible").withColumn("listed", F.lit(False))
    both = hits.select("page_id", "host", "path", F.coalesce("listed", F.lit(False)).alias("listed"))
    both = both.unionByName(missed.select("page_id", "host", "path", "listed"))
    both = both.withColumn("found", matching_rule(rules))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "listed"
    )


# Runs of marks that prose does not have.
NOISE = r"[*#%$]{3}"


def noisy_urls(pages: DataFrame) -> DataFrame:
    """The list used on crawled pages: canonical URLs under which a page with noise was found."""
    return listed_urls(pages.where(F.col("html").rlike(NOISE)))


ORACLE = r"""
WITH rest AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS query
  FROM rest),
named AS (
  SELECT page_id, html, host, path,
    CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '')
      || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '')
      || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
  FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM named WHERE canonical IS NOT NULL AND regexp_matches(html, '[*#%$]{3}')),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT n.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
    max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
  GROUP BY n.page_id)
SELECT n.page_id, n.host, n.path, f.rule,
  coalesce(f.verdict, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON l.canonical = n.canonical
"""
