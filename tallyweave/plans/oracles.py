"""Equivalent DuckDB SQL for the registered queries, written independently of the library.

Small Python helpers only assemble repeated SQL fragments; the fixed wording of reports is taken
from where it is stated.
"""

from __future__ import annotations

from tallyweave.plans.survey import GENERATOR
from tallyweave.sinks.reports import METHOD_NOTES, TITLE


def tidy(x: str) -> str:
    return f"(CAST(printf('%.11e', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def pct(count: str, valid: str) -> str:
    return f"(CASE WHEN {valid} = 0 THEN 0.0 ELSE floor(CAST({count} AS DOUBLE) / {valid} * 10000 + 0.5) / 100 END)"


def dec1(x: str) -> str:
    """One decimal, exact binary ties (quarters) upwards."""
    x = f"CAST({x} AS DOUBLE)"
    return f"printf('%.1f', {x} + CASE WHEN {x} * 4 = floor({x} * 4) AND {x} * 2 <> floor({x} * 2) THEN 0.01 ELSE 0.0 END)"


def freq(answers: str, order: str = "count DESC, label", extra: str = "", columns: str = "") -> str:
    """answers(rid, key, label): one row per respondent and spelling, label NULL when blank."""
    columns = columns or "rank, label, count, percentage"
    return f"""
    WITH a AS ({answers}),
    v AS (SELECT count(DISTINCT rid) AS valid, (SELECT count(DISTINCT rid) FROM a) - count(DISTINCT rid) AS blank
          FROM a WHERE label IS NOT NULL),
    f AS (SELECT key, arg_min(label, rid) AS label, count(DISTINCT rid) AS count
          FROM a WHERE label IS NOT NULL GROUP BY key),
    r AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, label, count, {pct("count", "valid")} AS percentage,
          valid, blank FROM f, v)
    SELECT {columns} FROM r {extra}"""


PRIORITY_BLANKS = """CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN NULL ELSE o_orderpriority END"""
O: dict[str, str] = {}

O["q_single_freq"] = freq(
    "SELECT o_orderkey rid, lower(o_orderpriority) AS key, o_orderpriority AS label FROM orders WHERE o_orderstatus <> 'P'"
)
O["q_freq_with_blanks"] = freq(
    f"SELECT o_orderkey rid, {PRIORITY_BLANKS} AS key, {PRIORITY_BLANKS} AS label FROM orders",
    columns="rank, label, count, percentage, valid, blank",
)
O["q_question_stats"] = f"""
    WITH i AS (SELECT *, {PRIORITY_BLANKS} AS p FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'orders' AS survey_id, 'priority' AS q_key, 'single' AS kind, false AS multiple, count(p) AS valid,
           count(*) - count(p) AS blank, count(p) AS total_selections FROM i
    UNION ALL SELECT 'orders', 'status', 'single', false, count(*), 0, count(*) FROM i
    UNION ALL SELECT 'orders', 'both', 'multiple', true, count(*), 0, 2 * count(*) FROM i
    UNION ALL SELECT 'orders', 'price', 'numeric', false, count(*), 0, count(*) FROM i
    UNION ALL SELECT 'customer', 'segment', 'single', false, count(*) FILTER (c_acctbal >= 0),
           count(*) FILTER (c_acctbal < 0), count(*) FILTER (c_acctbal >= 0) FROM customer
    UNION ALL SELECT 'customer', 'name', 'ignore', false, 0, count(*), 0 FROM customer"""

SHOP = """
    SELECT 'orders' AS survey_id, 'priority' AS q_key, o_orderpriority AS label FROM orders
    UNION ALL SELECT 'orders', 'status', o_orderstatus FROM orders
    UNION ALL SELECT 'part', 'brand', p_brand FROM part
    UNION ALL SELECT 'part', 'type', p_type FROM part
    UNION ALL SELECT 'part', 'name', p_name FROM part"""
SHOP_FREQ = f"""
    s AS ({SHOP}),
    f AS (SELECT survey_id, q_key, label, count(*) AS count FROM s GROUP BY ALL),
    g AS (SELECT *, sum(count) OVER (PARTITION BY survey_id, q_key) AS valid FROM f),
    t AS (SELECT survey_id, q_key, label, count, {pct("count", "valid")} AS percentage,
          row_number() OVER (PARTITION BY survey_id, q_key ORDER BY
            CASE WHEN q_key = 'priority' THEN CASE label WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END END,
            CASE WHEN q_key = 'brand' THEN CAST(regexp_extract(label, '[0-9]+') AS INT) END,
            CASE WHEN q_key <> 'brand' THEN count END DESC, label) AS rank FROM g)"""
O["q_all_questions_freq"] = f"WITH {SHOP_FREQ} SELECT survey_id, q_key, rank, label, count, percentage FROM t"
O["q_footer_totals"] = f"""WITH {SHOP_FREQ}
    SELECT survey_id, q_key, CAST(sum(count) AS BIGINT) AS count_sum,
           round(sum(percentage) * 100) / 100 AS percentage_sum, count(*) AS options FROM t GROUP BY ALL"""
O["q_column_report"] = f"""WITH {SHOP_FREQ},
    m(survey_id, q_ord, q_key) AS (VALUES ('orders', 0, 'priority'), ('orders', 1, 'status'),
        ('part', 0, 'brand'), ('part', 1, 'type'), ('part', 2, 'name'))
    SELECT survey_id, CAST(q_ord AS BIGINT) AS q_ord, q_key, q_key AS header, q_key AS label, 'single' AS kind,
           CAST(NULL AS VARCHAR) AS origin, (SELECT count(*) FROM t WHERE t.survey_id = m.survey_id AND t.q_key = m.q_key) AS options
    FROM m"""
O["q_chart_series"] = f"""WITH {SHOP_FREQ}
    SELECT survey_id, q_key, CASE q_key WHEN 'status' THEN 'pie' ELSE 'bar' END AS chart, rank, label, count, percentage
    FROM t WHERE q_key <> 'type'"""
O["q_selection"] = f"WITH {SHOP_FREQ} SELECT survey_id, q_key, rank, label, count, percentage FROM t WHERE q_key <> 'name'"

FLAGS = """SELECT DISTINCT l_orderkey AS rid, l_returnflag AS label FROM lineitem
           UNION SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem"""
O["q_multi_freq"] = freq(f"SELECT rid, label AS key, label FROM ({FLAGS})")
O["q_split_brackets"] = freq(
    """SELECT p_partkey AS rid, lower(l) AS key, l AS label FROM part, LATERAL (SELECT unnest([
         'その他(' || p_brand || ',' || p_type || '),' || p_type, p_name || '、x']) AS l)""",
    columns="label, count, percentage",
)
O["q_alias_canon"] = freq(
    """SELECT event_id AS rid, CASE event_type WHEN 'click' THEN 'クリック' WHEN 'purchase' THEN '購入' ELSE event_type END AS key,
         CASE event_type WHEN 'click' THEN 'クリック' WHEN 'purchase' THEN '購入'
              ELSE CASE WHEN value < 5 THEN upper(event_type) || '。' ELSE event_type END END AS label FROM events"""
)
O["q_preset_order"] = freq(
    "SELECT c_custkey AS rid, c_mktsegment AS key, c_mktsegment AS label FROM customer",
    order="CASE label WHEN 'HOUSEHOLD' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 4 END, count DESC, label",
)
O["q_count_order"] = freq("SELECT event_id AS rid, event_type AS key, event_type AS label FROM events")
O["q_natural_order"] = freq(
    "SELECT p_partkey AS rid, p_brand AS key, p_brand AS label FROM part",
    order="CAST(regexp_extract(label, '[0-9]+') AS INT)",
)
O["q_record_vs_respondent"] = """
    SELECT event_type, count(*) AS records, count(DISTINCT user_id) AS respondents FROM events GROUP BY event_type"""

# ---- scalar functions ---------------------------------------------------------------------
O["q_text_normalise"] = """
    SELECT p_partkey, '【' || p_name || '】 ' || p_type || chr(10) || p_brand || '。.' AS norm,
           lower('【' || p_name || '】 ' || p_type || chr(10) || p_brand) AS grouping_key,
           lower(replace(p_name, ' ', '') || p_type || p_brand) AS header_key FROM part"""
O["q_blank_predicate"] = """
    WITH x AS (SELECT CASE WHEN p_size <= 5 THEN '－' WHEN p_size <= 10 THEN ' n/A　' WHEN p_size <= 15 THEN 'なし'
        WHEN p_size <= 20 THEN 'ー' WHEN p_size <= 25 THEN 'ＮＵＬＬ' WHEN p_size <= 30 THEN chr(10)
        WHEN p_size <= 35 THEN '0' ELSE p_name END AS cell FROM part)
    SELECT cell IN ('－', ' n/A　', 'ＮＵＬＬ', chr(10)) AS blank, cell, count(*) AS n FROM x GROUP BY ALL"""
DOC_NORM = "trim(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10))"
DOC_BLANK = f"lower({DOC_NORM}) IN ('', '-', '‐', '—', 'n/a', 'na', 'null', 'undefined')"
O["q_document_blanks"] = f"""
    SELECT doc_id, {DOC_BLANK} AS blank, length({DOC_NORM}) AS norm_length, md5({DOC_NORM}) AS norm_md5 FROM documents"""
O["q_numeric_extract"] = f"""
    SELECT p_partkey, p_size * 10000.0::DOUBLE AS man, (p_size + p_size + 5) * 1000 / 2.0::DOUBLE AS lent_range,
           (p_size + p_size + 5) / 2.0::DOUBLE AS word_range, p_size + 0.5::DOUBLE AS hours,
           {tidy("p_size / 60.0::DOUBLE")} AS minutes, CAST(p_partkey * 1000 + p_size AS DOUBLE) AS grouped,
           CAST(p_size * 11001 AS DOUBLE) AS mixed, CAST(-p_size AS DOUBLE) AS negative, CAST(NULL AS DOUBLE) AS none FROM part"""
O["q_year_month"] = freq(
    """SELECT o_orderkey AS rid, l AS key, l AS label FROM (SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 28 THEN
         CAST(CASE WHEN year(o_orderdate) % 100 < 100 THEN 2000 + year(o_orderdate) % 100 END AS VARCHAR)
         || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END AS l FROM orders)""",
    order="label",
)
WORK = """
    SELECT l_orderkey * 8 + l_linenumber AS rid, l_linestatus, l_linenumber AS n, CAST(l_quantity AS INT) AS q,
        CASE WHEN l_linestatus <> 'F' OR l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS days,
        CASE WHEN l_linestatus <> 'F' AND l_linenumber = 7 THEN NULL WHEN l_linenumber = 1 THEN NULL
             WHEN l_linenumber <= 3 THEN CAST(l_quantity AS INT)
             WHEN l_linenumber = 4 THEN CAST(l_quantity AS INT) * 60 + 30
             ELSE CAST(l_quantity AS INT) * 60 + l_linenumber END AS minutes,
        l_linestatus <> 'F' AND l_linenumber = 7 AS empty FROM lineitem"""
O["q_work_functions"] = f"SELECT CAST(days AS BIGINT) AS days, CAST(minutes AS BIGINT) AS minutes, count(*) AS n FROM ({WORK}) GROUP BY ALL"


def rows_freq(answers: str, order: str) -> str:
    """Like freq, but every row is a respondent of its own."""
    return f"""
    WITH a AS ({answers}), f AS (SELECT label, count(*) AS count FROM a GROUP BY label),
    v AS (SELECT count(*) AS valid FROM a)
    SELECT row_number() OVER (ORDER BY {order}) AS rank, label, count, {pct("count", "valid")} AS percentage FROM f, v"""


O["q_workdays"] = rows_freq(
    f"SELECT coalesce(CAST(days AS VARCHAR) || '日', '解析不能') AS label FROM ({WORK}) WHERE NOT empty",
    "CASE WHEN label = '解析不能' THEN 99 ELSE CAST(replace(label, '日', '') AS INT) END",
)
O["q_workminutes"] = rows_freq(
    f"""SELECT CASE WHEN minutes IS NULL THEN '解析不能' WHEN minutes < 30 THEN '30分未満' WHEN minutes < 60 THEN '30分~1時間未満'
        WHEN minutes < 120 THEN '1~2時間未満' WHEN minutes < 180 THEN '2~3時間未満' WHEN minutes < 300 THEN '3~5時間未満'
        WHEN minutes < 600 THEN '5~10時間未満' WHEN minutes < 1200 THEN '10~20時間未満' ELSE '20時間以上' END AS label
        FROM ({WORK}) WHERE NOT empty""",
    """list_position(['30分未満', '30分~1時間未満', '1~2時間未満', '2~3時間未満', '3~5時間未満', '5~10時間未満',
        '10~20時間未満', '20時間以上', '解析不能'], label)""",
)
O["q_split_answers"] = """
    SELECT p_partkey, CASE WHEN lower(p_name || '/' || p_type) = lower(p_type) THEN p_type ELSE p_name || '/' || p_type || ' # ' || p_type END
        || ' # 【a、' || p_brand || '】' AS answers FROM part"""

# ---- numeric ------------------------------------------------------------------------------
PRICE = """SELECT o_orderstatus AS survey_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL
             ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS v FROM orders"""
O["q_numeric_summary"] = f"""
    WITH p AS ({PRICE}),
    r AS (SELECT survey_id, v, row_number() OVER (PARTITION BY survey_id ORDER BY v) - 1 AS i,
          count(*) OVER (PARTITION BY survey_id) AS n FROM p WHERE v IS NOT NULL),
    g AS (SELECT survey_id, count(*) AS n, min(v) AS min, max(v) AS max,
          {tidy("sum(CAST(v AS DECIMAL(18,2)))")} AS sum,
          max(v) FILTER (i = floor(n * 0.25)) AS p25, max(v) FILTER (i = floor(n * 0.75)) AS p75,
          max(v) FILTER (i = (n - 1) // 2) AS a, max(v) FILTER (i = n // 2) AS b FROM r GROUP BY survey_id),
    u AS (SELECT survey_id, count(*) AS unparsed FROM p WHERE v IS NULL GROUP BY survey_id)
    SELECT survey_id, n, min, max, {tidy("sum / n")} AS mean, CASE WHEN a = b THEN a ELSE {tidy("(a + b) / 2")} END AS median,
           p25, p75, sum, unparsed FROM g JOIN u USING (survey_id)"""


def number_text(x: str, decimals: str) -> str:
    return f"""(CASE {decimals} WHEN 0 THEN format('{{:,}}', CAST(floor({x} + 0.5) AS BIGINT))
        WHEN 1 THEN format('{{:,.1f}}', {x}) WHEN 2 THEN format('{{:,.2f}}', {x}) WHEN 3 THEN format('{{:,.3f}}', {x})
        ELSE format('{{:,.4f}}', {x}) END)"""


def histogram(values: str, keys: str, name: str = "") -> str:
    """CTEs ending in `hist` for values(keys..., unit, v) where v is NULL when not a number.

    Every row is a valid answer. `hist` has keys, rank, label, bin_from, bin_to, count, percentage.
    """
    count_expr = f"greatest(1, CAST(ceil({tidy('(hi - s) / w')}) AS BIGINT))"
    return f"""
    av AS ({values}),
    va AS (SELECT {keys}, count(*) AS valid FROM av GROUP BY ALL),
    vc AS (SELECT {keys}, unit, v, count(*) AS c FROM av WHERE v IS NOT NULL GROUP BY ALL),
    sp AS (SELECT {keys}, unit, min(v) AS lo, max(v) AS hi, count(*) AS d, bool_or(v <> floor(v)) AS frac FROM vc GROUP BY ALL),
    ca AS (SELECT sp.*, {tidy("m * power(10.0::DOUBLE, floor(log10(hi - lo)) + e)")} AS w
           FROM sp, (VALUES (1), (2), (5)) mm(m), generate_series(-3, 2) ee(e) WHERE d > 10),
    st AS (SELECT *, {tidy("floor(" + tidy("lo / w") + ") * w")} AS s FROM ca),
    kk AS (SELECT *, {count_expr} AS k FROM st),
    sc AS (SELECT *, CASE WHEN k < 6 THEN 6 - k + 0.5 WHEN k > 12 THEN k - 12 ELSE 0 END AS score FROM kk WHERE k <= 400),
    la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score, w) AS rn FROM sc) WHERE rn = 1),
    ld AS (SELECT *, CASE WHEN NOT (frac OR w <> floor(w) OR s <> floor(s)) THEN 0 WHEN w >= 0.1 THEN 1
                          WHEN w >= 0.01 THEN 2 WHEN w >= 0.001 THEN 3 ELSE 4 END AS dec FROM la),
    cn AS (SELECT {keys}, least(k - 1, greatest(0, CAST(floor({tidy("(v - s) / w")}) AS BIGINT))) AS i, CAST(sum(c) AS BIGINT) AS count
           FROM vc JOIN ld USING ({keys}, unit) GROUP BY ALL),
    wide AS (SELECT {keys}, unit, i, coalesce(count, 0) AS count, {tidy("s + i * w")} AS f, {tidy("s + (i + 1) * w")} AS t,
                    k, hi, dec FROM (SELECT ld.*, unnest(generate_series(0, k - 1)) AS i FROM ld) LEFT JOIN cn USING ({keys}, i)),
    up AS (SELECT *, CASE WHEN i = k - 1 THEN greatest({tidy("t - power(10.0::DOUBLE, -dec)")}, hi)
                     ELSE {tidy("t - power(10.0::DOUBLE, -dec)")} END AS u FROM wide),
    al AS (SELECT {keys}, f AS bin_from, t AS bin_to, count, CASE WHEN f = u THEN {number_text("f", "dec")} || unit
                  ELSE {number_text("f", "dec")} || '〜' || {number_text("u", "dec")} || unit END AS label FROM up
           UNION ALL
           SELECT {keys}, v, v, c, {number_text("v", "CASE WHEN frac THEN 1 ELSE 0 END")} || unit
           FROM vc JOIN sp USING ({keys}, unit) WHERE d <= 10),
    hist AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY bin_from) AS rank, label, bin_from, bin_to, count,
             {pct("count", "valid")} AS percentage FROM al JOIN va USING ({keys}))"""


O["q_hist_discrete"] = f"""WITH {histogram('''
    SELECT 'line' AS q_key, '回' AS unit, CAST(l_linenumber AS DOUBLE) AS v FROM lineitem
    UNION ALL SELECT 'tax', '', CASE WHEN l_returnflag = 'R' THEN NULL ELSE floor(l_tax * 100) END FROM lineitem''', 'q_key')}
    SELECT q_key, rank, label, bin_from, bin_to, count, percentage FROM hist"""
O["q_hist_nice"] = f"""WITH {histogram(f'''
    SELECT survey_id, 'price' AS q_key, '円' AS unit, v FROM ({PRICE})
    UNION ALL SELECT 'part', 'size', '回', CAST(p_size AS DOUBLE) FROM part
    UNION ALL SELECT 'part', 'retail', '', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) FROM part''', 'survey_id, q_key')}
    SELECT survey_id, q_key, rank, label, bin_from, bin_to, count, percentage FROM hist"""

# ---- free text ----------------------------------------------------------------------------
O["q_free_text_sample"] = f"""
    SELECT source AS survey_id, CAST(rank AS INT) AS rank, substring({DOC_NORM}, 1, 200) AS sample FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE NOT {DOC_BLANK}) WHERE rank <= 20"""
O["q_free_text_report"] = f"""
    WITH e AS (SELECT * FROM documents WHERE NOT {DOC_BLANK}),
    h AS (SELECT source, count(*) AS n, (SELECT count(*) FROM e WHERE e.source = d.source) AS m FROM documents d GROUP BY source),
    lines AS (
        SELECT source AS survey_id, 0 AS section, 0 AS position,
               ['# 自由記述回答', '', '集計対象回答数: ' || n || '件', '自由記述あり: ' || m || '件', '対象の設問: 本文', '']
               || CASE WHEN m = 0 THEN ['（集計対象の回答に自由記述がありません）', ''] ELSE [] END AS ls FROM h
        UNION ALL SELECT source, 1, doc_id, ['## 回答 ' || (doc_id + 1), '', text, ''] FROM e)
    SELECT survey_id, CAST(section AS INT) AS section, CAST(position AS BIGINT) AS position,
           CAST(unnest(generate_series(0, len(ls) - 1)) AS INT) AS part, unnest(ls) AS line FROM lines"""

# ---- profiling ----------------------------------------------------------------------------
CELLS = """
    SELECT 'events' AS survey_id, 0 AS col_idx, concat_ws(', ', event_type, CASE WHEN value > 10 THEN 'big' END) AS x FROM events
    UNION ALL SELECT 'events', 1, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) FROM events
    UNION ALL SELECT 'events', 2, props FROM events
    UNION ALL SELECT 'events', 3, CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT 'orders', 0, o_orderpriority FROM orders
    UNION ALL SELECT 'orders', 1, CAST(o_totalprice AS DECIMAL(18,2)) || '円' FROM orders
    UNION ALL SELECT 'orders', 2, CASE WHEN o_orderstatus = 'P' THEN '-' ELSE o_orderstatus END FROM orders
    UNION ALL SELECT 'orders', 3, strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT 'part', 0, p_brand FROM part
    UNION ALL SELECT 'part', 1, p_type FROM part
    UNION ALL SELECT 'part', 2, '' FROM part
    UNION ALL SELECT 'part', 3, CAST(p_size AS VARCHAR) FROM part
    UNION ALL SELECT 'part', 4, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) FROM part
    UNION ALL SELECT 'part', 5, p_name FROM part
    UNION ALL SELECT 'documents', 0, lang FROM documents
    UNION ALL SELECT 'documents', 1, source FROM documents
    UNION ALL SELECT 'documents', 2, CAST(n_chars AS VARCHAR) FROM documents"""
BLANKS = "('', '-', '‐', '—', 'n/a', 'na', 'null', 'undefined')"
INFER = f"""
    cells AS ({CELLS}),
    norm AS (SELECT survey_id, col_idx, x, trim(x) AS t, lower(trim(x)) NOT IN {BLANKS} AS filled FROM cells),
    parts AS (SELECT *, CASE WHEN filled THEN list_distinct([k FOR k IN [trim(rtrim(lower(trim(p)), '。、．，.,')) FOR p IN
                  string_split_regex(x, '[\\n,、;；|｜]')] IF k NOT IN {BLANKS}]) ELSE [] END AS ps,
              trim(rtrim(lower(t), '。、．，.,')) AS key FROM norm),
    tok AS (SELECT survey_id, col_idx, count(DISTINCT p) AS n FROM (SELECT survey_id, col_idx, unnest(ps) AS p FROM parts) GROUP BY ALL),
    cnt AS (SELECT survey_id, col_idx, count(*) FILTER (filled) AS filled, count(*) FILTER (filled AND contains(x, chr(10))) AS multiline,
                   count(*) FILTER (filled AND regexp_matches(x, '[0-9]')) AS parsed, count(*) FILTER (len(ps) >= 2) AS split_rows,
                   count(DISTINCT key) FILTER (filled) AS dv FROM parts GROUP BY ALL),
    both_ AS (SELECT cnt.*, dv AS distinct_values, coalesce(tok.n, 0) AS distinct_tokens
              FROM cnt LEFT JOIN tok USING (survey_id, col_idx)),
    inf AS (SELECT *, CASE WHEN filled = 0 THEN 'ignore'
            WHEN multiline / filled < 0.3 AND parsed / filled >= 0.9 AND distinct_values > 12 THEN 'numeric'
            WHEN split_rows / filled >= 0.15 AND distinct_tokens <= 40 THEN 'multiple'
            WHEN dv <= 30 AND dv / filled <= 0.6 THEN 'single' ELSE 'free' END AS kind FROM both_),
    infc AS (SELECT *, CASE kind WHEN 'numeric' THEN 'bar' WHEN 'multiple' THEN 'hbar'
             WHEN 'single' THEN CASE WHEN dv <= 6 THEN 'pie' ELSE 'bar' END ELSE 'none' END AS chart FROM inf)"""
O["q_infer_kind"] = f"""WITH {INFER}
    SELECT survey_id, CAST(col_idx AS INT) AS col_idx, filled, multiline, parsed, split_rows, distinct_values, distinct_tokens, kind, chart FROM infc"""
# Bracket- and quote-aware split of whole texts, character by character: brackets count outside quotes only, quotes only
# when they are all closed, and a closing bracket never counts below the outermost level.
O["q_infer_kind_text"] = """
    WITH cells AS (SELECT 'documents' AS survey_id, 0 AS col_idx, doc_id AS id, coalesce(text, '') AS x FROM documents
        UNION ALL SELECT 'conversations', 0, conv_id * 4096 + turn, coalesce(role, '') FROM conversations
        UNION ALL SELECT 'conversations', 1, conv_id * 4096 + turn, coalesce(text, '') FROM conversations
        UNION ALL SELECT 'pages', 0, page_id, coalesce(url, '') FROM pages UNION ALL SELECT 'pages', 1, page_id, coalesce(html, '') FROM pages),
    lines AS (SELECT survey_id, col_idx, id, replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x, x AS raw FROM cells),
    chars AS (SELECT survey_id, col_idx, id, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) AS i,
                  (length(x) - length(replace(x, '"', ''))) % 2 = 0 AS closed FROM lines WHERE x <> ''),
    quoted AS (SELECT *, closed AND sum(CASE WHEN ch = '"' THEN 1 ELSE 0 END) OVER w % 2 = 1 AS q FROM chars
               WINDOW w AS (PARTITION BY survey_id, col_idx, id ORDER BY i)),
    steps AS (SELECT *, sum(CASE WHEN q OR (closed AND ch = '"') THEN 0 WHEN ch IN ('(', '（', '【', '「', '『') THEN 1
                                 WHEN ch IN (')', '）', '】', '」', '』') THEN -1 ELSE 0 END) OVER w AS s FROM quoted
              WINDOW w AS (PARTITION BY survey_id, col_idx, id ORDER BY i)),
    deep AS (SELECT *, s - least(0, min(s) OVER w) AS depth FROM steps WINDOW w AS (PARTITION BY survey_id, col_idx, id ORDER BY i)),
    cuts AS (SELECT *, NOT q AND depth = 0 AND ch IN (chr(10), ',', '、', ';', '；', '|', '｜') AS cut FROM deep),
    numbered AS (SELECT *, sum(cut::INT) OVER (PARTITION BY survey_id, col_idx, id ORDER BY i) AS piece FROM cuts),
    pieces AS (SELECT survey_id, col_idx, id, piece, coalesce(string_agg(ch, '' ORDER BY i) FILTER (NOT cut), '') AS p FROM numbered GROUP BY ALL),
    tidy AS (SELECT survey_id, col_idx, id, trim(regexp_replace(regexp_replace(p, '[ \\t\\v\\f\\r]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10)) AS p FROM pieces),
    bare AS (SELECT survey_id, col_idx, id, CASE WHEN regexp_full_match(p, '"[^"]*"|“[^"]*”') THEN trim(p[2:length(p) - 1], ' ' || chr(10)) ELSE p END AS p FROM tidy),
    tokens AS (SELECT DISTINCT survey_id, col_idx, id, trim(rtrim(lower(p), '。、．，.,'), ' ' || chr(10)) AS t FROM bare
               WHERE lower(p) NOT IN ('', '-', '‐', '—', 'n/a', 'na', 'null', 'undefined')),
    whole AS (SELECT *, trim(regexp_replace(regexp_replace(x, '[ \\t\\v\\f\\r]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10)) AS t FROM lines),
    named AS (SELECT *, lower(t) NOT IN ('', '-', '‐', '—', 'n/a', 'na', 'null', 'undefined') AS filled,
                  trim(rtrim(lower(t), '。、．，.,'), ' ' || chr(10)) AS key FROM whole),
    n_tokens AS (SELECT survey_id, col_idx, id, count(*) AS n FROM tokens GROUP BY ALL),
    kinds_of AS (SELECT survey_id, col_idx, count(DISTINCT t) AS n FROM tokens GROUP BY ALL),
    cnt AS (SELECT n.survey_id, n.col_idx, count(*) FILTER (filled) AS filled, count(*) FILTER (filled AND contains(raw, chr(10))) AS multiline,
                count(*) FILTER (filled AND regexp_matches(t, '[0-9]')) AS parsed, count(*) FILTER (filled AND k.n >= 2) AS split_rows,
                count(DISTINCT key) FILTER (filled) AS distinct_values
            FROM named n LEFT JOIN n_tokens k USING (survey_id, col_idx, id) GROUP BY ALL),
    both_ AS (SELECT c.*, coalesce(k.n, 0) AS distinct_tokens FROM cnt c LEFT JOIN kinds_of k USING (survey_id, col_idx)),
    inf AS (SELECT *, CASE WHEN filled = 0 THEN 'ignore'
            WHEN multiline / filled < 0.3 AND parsed / filled >= 0.9 AND distinct_values > 12 THEN 'numeric'
            WHEN split_rows / filled >= 0.15 AND distinct_tokens <= 40 THEN 'multiple'
            WHEN distinct_values <= 30 AND distinct_values / filled <= 0.6 THEN 'single' ELSE 'free' END AS kind FROM both_)
    SELECT survey_id, CAST(col_idx AS INT) AS col_idx, filled, multiline, parsed, split_rows, distinct_values, distinct_tokens, kind,
           CASE kind WHEN 'numeric' THEN 'bar' WHEN 'multiple' THEN 'hbar'
                WHEN 'single' THEN CASE WHEN distinct_values <= 6 THEN 'pie' ELSE 'bar' END ELSE 'none' END AS chart FROM inf"""
# header, base key, label, profile kind, profile chart, unit
META = """m(survey_id, col_idx, header, q_key, label, pk, pc, unit) AS (VALUES
    ('events', 0, 'Event type', 'type', '種類', 'multiple', 'hbar', NULL), ('events', 1, 'Value', 'q2', 'Value', NULL, NULL, NULL),
    ('events', 2, 'Props', 'q3', 'Props', NULL, NULL, NULL), ('events', 3, 'User', 'q4', 'User', NULL, NULL, NULL),
    ('orders', 0, 'Q1. Order priority', 'priority', '優先度', 'single', 'pie', NULL),
    ('orders', 1, 'Q2. Total price', 'price', '価格', 'single', 'bar', '円'),
    ('orders', 2, 'Status', 'q3', 'Status', NULL, NULL, NULL), ('orders', 3, 'Order date', 'priority-2', '優先度', 'single', 'pie', NULL),
    ('part', 0, 'Brand', 'q1', 'Brand', NULL, NULL, NULL), ('part', 1, 'Type', 'q2', 'Type', NULL, NULL, NULL),
    ('part', 2, 'Type (2)', 'q3', 'Type (2)', NULL, NULL, NULL), ('part', 3, 'Size', 'q4', 'Size', NULL, NULL, NULL),
    ('part', 4, 'Price', 'q5', 'Price', NULL, NULL, NULL), ('part', 5, 'Name', 'q6', 'Name', NULL, NULL, NULL),
    ('documents', 0, 'Lang', 'q1', 'Lang', NULL, NULL, NULL), ('documents', 1, 'Source', 'q2', 'Source', NULL, NULL, NULL),
    ('documents', 2, 'Length', 'q3', 'Length', NULL, NULL, NULL))"""
RESOLVED = f"""{INFER}, {META},
    k1 AS (SELECT m.*, CASE WHEN header = 'Size' THEN 'single' WHEN pk IS NULL THEN infc.kind
               WHEN pk = 'single' AND infc.kind = 'numeric' THEN 'numeric' ELSE pk END AS k, infc.chart AS ic FROM m JOIN infc USING (survey_id, col_idx)),
    k2 AS (SELECT *, CASE WHEN header = 'Size' THEN CASE WHEN ic = 'none' THEN 'bar' ELSE ic END
               WHEN pk IS NULL THEN ic WHEN k = 'numeric' THEN 'bar' ELSE pc END AS c FROM k1)"""
O["q_kind_resolution"] = f"""WITH {RESOLVED},
    k3 AS (SELECT *, CASE WHEN survey_id = 'part' AND q_key = 'q6' THEN 'multiple' ELSE k END AS kind FROM k2)
    SELECT survey_id, CAST(col_idx AS INT) AS q_ord, q_key, header, label, kind,
           CASE WHEN survey_id = 'part' AND q_key = 'q6' AND k <> 'multiple' THEN 'hbar'
                WHEN survey_id = 'orders' AND q_key = 'priority' THEN 'bar' ELSE c END AS chart,
           unit, pk IS NULL AS inferred, CASE WHEN kind = 'multiple' THEN 7 ELSE 0 END::BIGINT AS delimiters FROM k3"""
O["q_default_axes"] = f"""WITH {RESOLVED},
    e AS (SELECT survey_id, list(q_key ORDER BY col_idx) AS ks FROM k2 WHERE k IN ('single', 'multiple', 'numeric') GROUP BY survey_id),
    r AS (SELECT *, CASE WHEN list_contains(ks, 'q3') THEN 'q3' ELSE ks[1] END AS row_key FROM e)
    SELECT survey_id, row_key, coalesce([x FOR x IN ks IF x <> row_key][1], row_key) AS col_key FROM r"""
O["q_profile_match"] = """
    WITH h AS (SELECT p_partkey, regexp_replace(lower(CASE WHEN p_size > 25 THEN 'Q' || p_partkey || '. ' || p_name || ' (' || p_type || ')'
                   ELSE p_name || p_type END), '[^a-z0-9]', '', 'g') AS h FROM part),
    p(t, o, k) AS (VALUES ('ring', 0, 'ring'), ('redring', 0, 'ring'), ('bluering', 0, 'ring'), ('small', 1, 'small'),
        ('economy', 2, 'economy'), ('ringeconomy', 2, 'economy'), ('widget', 3, 'widget'), ('exact', 4, 'exact'), ('oldrodsmall', 4, 'exact')),
    r AS (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY (h = t) DESC, length(t) DESC, o) AS rn
          FROM h JOIN p ON contains(h, t))
    SELECT p_partkey, k AS profile_key FROM part LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (p_partkey)"""

# ---- layout -------------------------------------------------------------------------------
FOLDED = """SELECT l_returnflag AS flag, list_distinct([x FOR x IN [CASE WHEN l_linestatus = 'O' THEN 'OPEN' END,
        CASE WHEN l_quantity > 25 THEN 'large order' END, CASE WHEN l_discount > 0.05 THEN 'OPEN' END] IF x IS NOT NULL]) AS fs FROM lineitem"""
O["q_wide_fold"] = f"""
    WITH f AS (SELECT l.*, list_distinct([x FOR x IN [CASE WHEN l_linestatus = 'O' THEN 'OPEN' END, CASE WHEN l_quantity > 25 THEN 'large order' END,
        CASE WHEN l_discount > 0.05 THEN 'OPEN' END] IF x IS NOT NULL]) AS fs FROM lineitem l)
    SELECT 'https://example.invalid' AS c2, CAST(l_shipdate AS VARCHAR) AS c3, l_returnflag AS c4,
        CASE WHEN list_contains(fs, 'OPEN') AND list_contains(fs, 'large order') THEN
             CASE WHEN l_linestatus = 'O' THEN 'OPEN' || chr(10) || 'large order' ELSE 'large order' || chr(10) || 'OPEN' END
             WHEN len(fs) = 1 THEN fs[1] ELSE '' END AS c5, CAST(l_quantity AS VARCHAR) AS c6, CAST(7 AS BIGINT) AS width, count(*) AS n,
        CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_suppkey) AS BIGINT) AS suppliers,
        '0 作業ID -; 1 作業者 -; 2 作業者ページURL -; 3 承認日時 -; 4 1. フラグ single; 5 2. 特徴 multiple; 6 3. 数量 -' AS layout
    FROM f GROUP BY ALL"""
O["q_fold_freq"] = f"""
    WITH x AS ({FOLDED}),
    a AS (SELECT 'flag' AS q_key, flag AS label, (SELECT count(*) FROM x) AS valid FROM x
          UNION ALL SELECT 'features', unnest(fs), (SELECT count(*) FROM x WHERE len(fs) > 0) FROM x),
    f AS (SELECT q_key, label, valid, count(*) AS count FROM a GROUP BY ALL)
    SELECT q_key, row_number() OVER (PARTITION BY q_key ORDER BY count DESC, label) AS rank, label, count, {pct("count", "valid")} AS percentage FROM f"""
O["q_detect_layout"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS survey_id, c_mktsegment <> 'BUILDING' AND (c_acctbal > 5000 OR c_acctbal < 1000) AS paired FROM customer"""
O["q_header_uniquify"] = """
    WITH w AS (SELECT p_partkey, p_size, p_type AS t, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
    h AS (SELECT CAST(p_partkey AS VARCHAR) AS survey_id, [a, b, t, t || ' (2)', a || ' (2)', b || ' (2)', t || ' (3)', '列8',
              CASE WHEN p_size > 25 THEN '列9' ELSE '列8 (2)' END] AS hs,
              [false, false, false, false, false, false, false, true, p_size > 25] AS es,
              [false, false, false, false, true, true, true, false, p_size <= 25] AS rs FROM w)
    SELECT survey_id, unnest(generate_series(0, 8)) AS col_idx, unnest(hs) AS header, unnest(es) AS is_empty, unnest(rs) AS renamed FROM h"""


# ---- cross-tabs ---------------------------------------------------------------------------
def crosstab(answers: str, row_order: str, col_order: str) -> str:
    """CTEs ending in `ct`; answers(rid, r, c) has one row per respondent, row and column option."""
    return f"""
    an AS ({answers}),
    cell AS (SELECT r, c, count(DISTINCT rid) AS count FROM an GROUP BY ALL),
    rt AS (SELECT r, count(DISTINCT rid) AS row_total, row_number() OVER (ORDER BY {row_order}) AS row_rank FROM an GROUP BY r),
    cl AS (SELECT c, count(DISTINCT rid) AS col_total, row_number() OVER (ORDER BY {col_order}) AS col_rank FROM an GROUP BY c),
    gt AS (SELECT count(DISTINCT rid) AS grand_total FROM an),
    ct AS (SELECT row_rank, r AS row_label, col_rank, c AS col_label, count, row_total, col_total, grand_total
           FROM cell JOIN rt USING (r) JOIN cl USING (c), gt)"""


SEG = f"""SELECT o_orderkey AS rid, c_mktsegment AS r, {PRIORITY_BLANKS} AS c FROM orders JOIN customer ON o_custkey = c_custkey
          WHERE o_orderstatus <> 'P' AND {PRIORITY_BLANKS} IS NOT NULL"""
SEG_CT = crosstab(SEG, "r", "CASE c WHEN '4-NOT SPECIFIED' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, count(DISTINCT rid) DESC, c")
O["q_crosstab"] = f"WITH {SEG_CT} SELECT * FROM ct"
O["q_crosstab_pct"] = f"""WITH {SEG_CT} SELECT row_label, col_label, count, CAST(count AS DOUBLE) / row_total * 100 AS row_pct,
    CAST(count AS DOUBLE) / col_total * 100 AS col_pct, CAST(count AS DOUBLE) / grand_total * 100 AS total_pct FROM ct"""
O["q_crosstab_margins"] = f"""WITH {crosstab(f"SELECT rid, label AS r, o_orderstatus AS c FROM ({FLAGS}) JOIN orders ON rid = o_orderkey", "r", "c")}
    SELECT * FROM ct"""
NUM = """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_orderstatus END AS st,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS v FROM orders"""
O["q_crosstab_numeric"] = f"""WITH {histogram(f"SELECT 'p' AS q_key, '円' AS unit, v FROM ({NUM})", "q_key")},
    nb AS (SELECT o_orderkey, st, label, bin_from FROM ({NUM}) n JOIN hist ON v >= bin_from AND (v < bin_to OR (v = bin_to AND bin_to = (SELECT max(bin_to) FROM hist)))
           WHERE st IS NOT NULL),
    {crosstab("SELECT o_orderkey AS rid, st AS r, label AS c FROM nb", "r", "CAST(replace(string_split(c, '〜')[1], ',', '') AS DOUBLE)")}
    SELECT * FROM ct"""
ALL4 = f"""SELECT o_orderkey AS rid, 'status' AS q, o_orderstatus AS l FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT o_orderkey, 'priority', {PRIORITY_BLANKS} FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT o_orderkey, 'segment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey"""
O["q_crosstab_all_pairs"] = f"""
    WITH q4 AS (SELECT * FROM ({ALL4}) WHERE l IS NOT NULL),
    j AS (SELECT a.q AS row_key, b.q AS col_key, a.l AS r, b.l AS c, a.rid FROM q4 a JOIN q4 b ON a.rid = b.rid AND a.q <> b.q),
    cell AS (SELECT row_key, col_key, r, c, count(*) AS count FROM j GROUP BY ALL),
    rt AS (SELECT row_key, col_key, r, CAST(sum(count) AS BIGINT) AS row_total, row_number() OVER (PARTITION BY row_key, col_key ORDER BY r) AS row_rank FROM cell GROUP BY row_key, col_key, r),
    cl AS (SELECT row_key, col_key, c, CAST(sum(count) AS BIGINT) AS col_total, row_number() OVER (PARTITION BY row_key, col_key ORDER BY c) AS col_rank FROM cell GROUP BY row_key, col_key, c),
    gt AS (SELECT row_key, col_key, CAST(sum(count) AS BIGINT) AS grand_total FROM cell GROUP BY ALL)
    SELECT row_key, col_key, row_rank, r AS row_label, col_rank, c AS col_label, count, row_total, col_total, grand_total
    FROM cell JOIN rt USING (row_key, col_key, r) JOIN cl USING (row_key, col_key, c) JOIN gt USING (row_key, col_key)"""
ALL8 = f"""SELECT * FROM ({ALL4})""" + "".join(
    f" UNION ALL SELECT o_orderkey, '{q}', CAST({x} AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey"
    for q, x in (("month", "month(o_orderdate)"), ("nation", "c_nationkey"), ("quarter", "quarter(o_orderdate)"), ("weekday", "dayofweek(o_orderdate) + 1"))
)
O["q_crosstab_bitmaps"] = f"""
    WITH place(q, i) AS (VALUES ('status', 0), ('priority', 1), ('segment', 2), ('year', 3), ('month', 4), ('nation', 5), ('quarter', 6), ('weekday', 7)),
    q8 AS (SELECT * FROM ({ALL8}) JOIN place USING (q) WHERE l IS NOT NULL),
    cell AS (SELECT a.q AS row_key, b.q AS col_key, a.l AS row_label, b.l AS col_label, count(*) AS count
             FROM q8 a JOIN q8 b ON a.rid = b.rid AND a.i < b.i GROUP BY ALL)
    SELECT row_key, col_key, row_label, col_label, count,
      CAST(sum(count) OVER (PARTITION BY row_key, col_key, row_label) AS BIGINT) AS row_total,
      CAST(sum(count) OVER (PARTITION BY row_key, col_key, col_label) AS BIGINT) AS col_total,
      CAST(sum(count) OVER (PARTITION BY row_key, col_key) AS BIGINT) AS grand_total
    FROM cell"""
NATION = """SELECT c_custkey AS rid, CAST(c_nationkey AS VARCHAR) AS r,
    CASE WHEN c_acctbal > 9000 THEN 'big ' || c_mktsegment ELSE c_mktsegment END AS c FROM customer"""
O["q_crosstab_dense"] = f"""WITH {crosstab(NATION, "CAST(r AS INT)", "lower(c)")}
    SELECT row_rank, r AS row_label, col_rank, c AS col_label, coalesce(count, 0) AS count, row_total, col_total, grand_total
    FROM rt CROSS JOIN cl LEFT JOIN cell USING (r, c), gt"""
SEG_ROWS = f"""{SEG_CT},
    rowcells AS (SELECT row_rank, r, row_total, list(coalesce(count, 0) ORDER BY col_rank) AS cs FROM rt CROSS JOIN cl LEFT JOIN cell USING (r, c) GROUP BY ALL),
    heads AS (SELECT list(c ORDER BY col_rank) AS hs, list(col_total ORDER BY col_rank) AS ts FROM cl)"""
O["q_crosstab_csv"] = f"""WITH {SEG_ROWS}
    SELECT 0 AS section, 0::BIGINT AS position, 0 AS part, '# 行: 区分 / 列: 優先|度 / 有効回答者数: ' || grand_total || ' / 表示: count' AS line FROM gt
    UNION ALL SELECT 1, 0, 0, '区分,' || array_to_string(hs, ',') || ',合計(実人数)' FROM heads
    UNION ALL SELECT 1, row_rank, 0, r || ',' || array_to_string(cs, ',') || ',' || row_total FROM rowcells
    UNION ALL SELECT 1, 9223372036854775807, 0, '合計(実人数),' || array_to_string(ts, ',') || ',' || grand_total FROM heads, gt"""
O["q_crosstab_markdown"] = f"""WITH {SEG_ROWS},
    sh AS (SELECT row_rank, r, row_total, list(count || ' (' || {dec1("CAST(count AS DOUBLE) / row_total * 100")} || '%)' ORDER BY col_rank) AS cs
           FROM (SELECT row_rank, r, row_total, col_rank, coalesce(count, 0) AS count FROM rt CROSS JOIN cl LEFT JOIN cell USING (r, c)) GROUP BY ALL),
    ls AS (SELECT 0 AS section, 0::BIGINT AS position, ['## クロス集計: 区分 × 優先|度', '',
               '対象者数（行・列の両方に有効回答）: ' || format('{{:,}}', grand_total) || '件', '表示: 実数（行%）… 割合の分母は各行の該当者数', ''] AS l FROM gt
        UNION ALL SELECT 1, 0, ['| 区分 | ' || array_to_string(hs, ' | ') || ' | 合計(実人数) |', '|---' || repeat('|---:', len(hs) + 1) || '|'] FROM heads
        UNION ALL SELECT 1, row_rank, ['| ' || r || ' | ' || array_to_string(cs, ' | ') || ' | ' || format('{{:,}}', row_total) || ' |'] FROM sh
        UNION ALL SELECT 1, 9223372036854775807, ['| 合計(実人数) | ' || array_to_string([format('{{:,}}', x) FOR x IN ts], ' | ')
               || ' | ' || format('{{:,}}', grand_total) || ' |', ''] FROM heads, gt)
    SELECT section, position, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS part, unnest(l) AS line FROM ls"""

# ---- rows, columns and policy -------------------------------------------------------------
NOTE = "c_name || ' / ' || c_mktsegment || ' / ' || c_nationkey || ' / ' || CAST(c_acctbal AS DECIMAL(18,2))"
BALANCE = "CAST(c_acctbal AS DECIMAL(18,2)) || ', \"yen\"'"
O["q_search_exclude"] = freq(
    f"""SELECT c_custkey AS rid, c_mktsegment AS key, c_mktsegment AS label FROM customer
        WHERE NOT contains(c_name, 'Customer#0000000') AND NOT contains({NOTE}, '/ 1')"""
)
O["q_exclusion_overlay"] = freq(
    "SELECT o_orderkey AS rid, o_orderpriority AS key, o_orderpriority AS label FROM orders WHERE o_orderstatus <> 'F'"
)
EDITED = """SELECT *, CASE WHEN o_totalprice > 150000 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p FROM orders
    WHERE o_orderstatus <> 'P' AND o_totalprice >= 160000 OR o_orderstatus = 'P' AND o_totalprice >= 300000 OR o_totalprice < 20000"""
EDITED_PRIORITY = "SELECT o_orderkey AS rid, lower(p) AS key, p AS label FROM ({}) e".format(EDITED)
EDITED_STATUS = "SELECT o_orderkey AS rid, lower(o_orderstatus) AS key, o_orderstatus AS label FROM ({}) e".format(EDITED)
O["q_frequency_after_edits"] = "SELECT * FROM ({}) UNION ALL SELECT * FROM ({})".format(
    freq(EDITED_PRIORITY, columns="'priority' AS q_key, rank, label, count, percentage"),
    freq(f"{EDITED_PRIORITY} UNION ALL {EDITED_STATUS}", columns="'both' AS q_key, rank, label, count, percentage"),
)
O["q_response_counters"] = """
    SELECT o_orderstatus AS survey_id, count(*) AS total,
           count(*) FILTER (contains(o_orderpriority, '77') OR contains(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '77')) AS matched,
           count(*) FILTER (o_totalprice > 50000) AS included, count(*) FILTER (NOT o_totalprice > 50000) AS excluded
    FROM orders GROUP BY o_orderstatus"""


def shown(x: str) -> str:
    return f"CASE WHEN length({x}) > 40 THEN substring({x}, 1, 40) || '…' ELSE {x} END"


O["q_listing_page"] = f"""
    SELECT c_custkey + 1 AS no, c_mktsegment <> 'HOUSEHOLD' AND NOT contains(lower({NOTE}), 'house') AS included,
           {shown("c_mktsegment")} AS cell0, {shown(NOTE)} AS cell1, {shown(BALANCE)} AS cell2, CAST(NULL AS VARCHAR) AS cell3
    FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 200"""
O["q_identity_mask"] = f"""
    SELECT c_custkey + 1 AS no, true AS included, c_mktsegment AS cell0, {NOTE} AS cell1, {BALANCE} AS cell2, CAST(NULL AS VARCHAR) AS cell3 FROM customer"""
O["q_identity_columns"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS survey_id, position, identity, col_idx FROM customer, LATERAL (VALUES
        (1::BIGINT, 'worker-name', 3::BIGINT), (3, 'worker-id', 2), (4, CASE WHEN c_acctbal > 0 THEN 'approved-at' END, 0)) v(position, identity, col_idx)
    WHERE identity IS NOT NULL"""
O["q_audit_export"] = f"""
    SELECT 0 AS section, 0::BIGINT AS position, 0 AS part, 'No,segment,note,"残高, 円",included' AS line
    UNION ALL SELECT 1, c_custkey + 1, 0, (c_custkey + 1) || ',' || c_mktsegment || ',' || {NOTE} || ',"' || replace({BALANCE}, '"', '""') || '",'
        || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'false' ELSE 'true' END FROM customer"""

# ---- whole-survey results -----------------------------------------------------------------
MIXED = f"""
    inc AS (SELECT *, {PRIORITY_BLANKS} AS p FROM orders WHERE o_totalprice > 5000),
    {histogram("SELECT 'price' AS q_key, '円' AS unit, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders WHERE o_totalprice > 5000", "q_key")},
    ans AS (SELECT 'orders' AS survey_id, 'priority' AS q_key, p AS label FROM inc WHERE p IS NOT NULL
        UNION ALL SELECT 'orders', 'status', o_orderstatus FROM inc
        UNION ALL SELECT 'orders', 'status', 'large' FROM inc WHERE o_totalprice > 250000
        UNION ALL SELECT 'documents', 'lang', lang || ' | "a"' || chr(10) || 'b' FROM documents),
    qm(survey_id, q_ord, q_key, question, kind, multiple) AS (VALUES ('orders', 0, 'priority', '優先度', 'single', false),
        ('orders', 1, 'status', '状態|区分', 'multiple', true), ('orders', 2, 'price', '価格', 'numeric', false),
        ('orders', 3, 'none', '無回答', 'single', false), ('documents', 0, 'lang', '言語, lang', 'single', false),
        ('documents', 1, 'text', '本文', 'free', false)),
    val AS (SELECT q_key, total, CASE q_key WHEN 'priority' THEN (SELECT count(p) FROM inc) WHEN 'none' THEN 0
                WHEN 'text' THEN (SELECT count(*) FROM documents WHERE NOT {DOC_BLANK}) ELSE total END AS valid
            FROM (SELECT q_key, CASE survey_id WHEN 'orders' THEN (SELECT count(*) FROM inc) ELSE (SELECT count(*) FROM documents) END AS total FROM qm)),
    fr AS (SELECT survey_id, q_key, label, count(*) AS count FROM ans GROUP BY ALL),
    items AS (SELECT survey_id, q_key, row_number() OVER (PARTITION BY q_key ORDER BY count DESC, label) AS rank, label, count,
                     {pct("count", "valid")} AS percentage FROM fr JOIN val USING (q_key)
              UNION ALL SELECT 'orders', q_key, rank, label, count, percentage FROM hist),
    srow AS (SELECT qm.survey_id, CAST(q_ord AS INT) AS q_ord, coalesce(rank, 1) AS rank, question,
                 CASE WHEN label IS NOT NULL THEN label WHEN kind = 'free' THEN '(自由記述)' ELSE '(回答なし)' END AS option,
                 CASE WHEN label IS NOT NULL THEN count WHEN kind = 'free' THEN valid ELSE 0 END AS count,
                 CASE WHEN label IS NOT NULL THEN percentage WHEN kind = 'free' AND valid > 0 THEN 100.0 ELSE 0.0 END AS percentage,
                 valid AS valid_responses, multiple AS multiple_choice
             FROM qm JOIN val USING (q_key) LEFT JOIN items USING (q_key))"""
O["q_summary_rows"] = f"WITH {MIXED} SELECT * FROM srow"


def csv(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[",\\r\\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""


O["q_summary_csv"] = f"""WITH {MIXED}
    SELECT s AS survey_id, 0 AS section, 0::BIGINT AS position, 0 AS part, 'question,option,count,percentage,valid_responses,multiple_choice' AS line
    FROM (VALUES ('orders'), ('documents')) t(s)
    UNION ALL SELECT survey_id, 1, q_ord, CAST(rank AS INT), {csv("question")} || ',' || {csv("option")} || ',' || count || ','
        || printf('%.2f', CAST(percentage AS DOUBLE)) || ',' || valid_responses || ',' || CASE WHEN multiple_choice THEN 'true' ELSE 'false' END FROM srow"""
STAT = f"""
    pv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM inc)),
    ps AS (SELECT count(*) AS n, {tidy(tidy("sum(CAST(v AS DECIMAL(18,2)))") + " / count(*)")} AS mean, min(v) AS lo, max(v) AS hi,
        max(v) FILTER (i = floor(n * 0.25)) AS p25, max(v) FILTER (i = floor(n * 0.75)) AS p75,
        max(v) FILTER (i = (n - 1) // 2) AS a, max(v) FILTER (i = n // 2) AS b FROM pv),
    pm AS (SELECT *, CASE WHEN a = b THEN a ELSE {tidy("(a + b) / 2")} END AS median FROM ps)"""
O["q_analysis_json"] = f"""WITH {MIXED}, {STAT}
    SELECT qm.survey_id AS source, CASE qm.survey_id WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE total END AS total, total AS included,
           CAST(q_ord AS BIGINT) AS q_ord, q_key, kind, valid,
           CASE q_key WHEN 'status' THEN (SELECT count(*) FROM ans WHERE q_key = 'status') ELSE valid END AS selections,
           CASE q_key WHEN 'price' THEN (SELECT median FROM pm) END AS median,
           question, multiple, total - valid AS blank,
           coalesce((SELECT string_agg(label || '=' || count || '=' || printf('%.2f', CAST(percentage AS DOUBLE)), ' ; ' ORDER BY rank)
                     FROM items i WHERE i.q_key = qm.q_key), '') AS items,
           CASE kind WHEN 'free' THEN coalesce((SELECT string_agg(substring({DOC_NORM}, 1, 200), ' ; ' ORDER BY doc_id)
                FROM (SELECT * FROM documents WHERE NOT {DOC_BLANK} ORDER BY doc_id LIMIT 20)), '') ELSE '-' END AS samples
    FROM qm JOIN val USING (q_key)"""


def money1(x: str) -> str:
    """Plain when whole, else one decimal; grouped."""
    one = f"CAST({dec1(x)} AS DECIMAL(18,1))"
    return f"CASE WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE format('{{:,.1f}}', CAST({one} AS DOUBLE)) END"


def always1(x: str) -> str:
    return f"format('{{:,.1f}}', CAST(CAST({dec1(x)} AS DECIMAL(18,1)) AS DOUBLE))"


O["q_report_lines"] = f"""WITH {MIXED}, {STAT},
    nl AS (SELECT ['- 件数: ' || format('{{:,}}', n) || '件', '- 平均: ' || {always1("mean")} || '円', '- 中央値: ' || {always1("median")} || '円',
        '- 最小: ' || {money1("lo")} || '円', '- 最大: ' || {money1("hi")} || '円', '- 第1四分位: ' || {money1("p25")} || '円',
        '- 第3四分位: ' || {money1("p75")} || '円', ''] AS l FROM pm),
    tot AS (SELECT 'orders' AS survey_id, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM inc) AS included
        UNION ALL SELECT 'documents', count(*), count(*) FROM documents),
    ends AS (SELECT survey_id, 0 AS section, ['{TITLE}', '', '- データ名: ' || survey_id, '- 生成日時: now', '- 出力元: {GENERATOR}',
                 '- 全回答数: ' || format('{{:,}}', total) || '件', '- 有効回答数(集計対象): ' || format('{{:,}}', included) || '件',
                 '- 除外回答数: ' || format('{{:,}}', total - included) || '件', ''] AS l FROM tot
             UNION ALL SELECT survey_id, 2, [{", ".join(f"'{note}'" for note in METHOD_NOTES)}] FROM tot),
    blk AS (SELECT qm.survey_id, CAST(q_ord * 3 AS BIGINT) AS position, ['## ' || question, '']
        || CASE WHEN multiple THEN ['※複数回答（合計が100%を超えることがあります）', ''] ELSE [] END
        || ['有効回答数: ' || format('{{:,}}', valid) || '件（未回答 ' || format('{{:,}}', total - valid) || '件 / 集計対象 ' || format('{{:,}}', total) || '件）', '']
        || CASE WHEN kind = 'numeric' THEN (SELECT l FROM nl) ELSE [] END
        || CASE WHEN kind = 'free' THEN ['回答件数: ' || format('{{:,}}', valid) || '件（本文は個人情報配慮のため出力しません）', '']
                WHEN q_key = 'none' THEN ['（集計対象となる回答がありません）', ''] ELSE ['| 選択肢 | 人数 | 割合 |', '|---|---:|---:|'] END AS l
        FROM qm JOIN val USING (q_key)
        UNION ALL SELECT survey_id, q_ord * 3 + 2, [''] FROM qm WHERE q_key NOT IN ('text', 'none'))
    SELECT survey_id, 1 AS section, position, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS part, unnest(l) AS line FROM blk
    UNION ALL SELECT survey_id, section, 0, CAST(unnest(generate_series(0, len(l) - 1)) AS INT), unnest(l) FROM ends
    UNION ALL SELECT items.survey_id, 1, q_ord * 3 + 1, CAST(rank AS INT), '| ' || replace(replace(label, '|', '\\|'), chr(10), ' ') || ' | ' || format('{{:,}}', count) || ' | '
        || {dec1("percentage")} || '% |' FROM items JOIN qm USING (q_key)"""

# ---- delimited files and assembled exports ------------------------------------------------
EXPORTS = """e AS (SELECT CAST(p_partkey AS VARCHAR) AS survey_id, p.*, [',', chr(9), ';', '|'][p_size % 4 + 1] AS d, p_size % 3 = 0 AS cp932,
        p_size % 7 = 0 AS opened, p_size % 7 <> 0 AND p_size % 5 <> 0 AS ended FROM part p)"""
O["q_sniff_delimiter"] = f"WITH {EXPORTS} SELECT survey_id, d AS delimiter, NOT cp932 AS utf8, ended AS ends_lf FROM e"
O["q_delimited_read"] = f"""WITH {EXPORTS}, r AS (
    SELECT survey_id, unnest([[survey_id, p_name, '5"monitor'], [survey_id, p_type || chr(13) || chr(10) || 'with "quotes" and ' || d, 'x'],
        [p_brand, '', '']] || CASE WHEN opened THEN [['open' || d || p_name, '', '']] ELSE [] END) AS cells,
        unnest(generate_series(0, CASE WHEN opened THEN 3 ELSE 2 END)) AS response_id FROM e)
    SELECT survey_id, response_id, array_to_string(cells, '␟') AS cells FROM r"""
O["q_ragged_accounting"] = f"""WITH {EXPORTS}, w AS (
    SELECT survey_id, unnest(['truncated-rows', 'blank-rows', 'decoded-as-cp932', 'unclosed-quote']) AS code,
        unnest([1, 1 + ended::INT, cp932::INT, opened::INT]) AS n FROM e)
    SELECT survey_id, code, CAST(n AS BIGINT) AS n FROM w WHERE n > 0"""
O["q_encoding_fallback"] = f"""WITH {EXPORTS}
    SELECT survey_id, unnest([0, 1, 2])::BIGINT AS col_idx, unnest(['番号', 'name', 'note']) AS header, false AS is_empty, false AS renamed FROM e"""
ASSEMBLED = f"""
    x AS (SELECT l_returnflag AS flag, [v FOR v IN [CASE WHEN l_quantity > 25 THEN '大口' END, CASE WHEN l_discount > 0.05 THEN '値引' END] IF v IS NOT NULL] AS fs,
              CAST(year(l_shipdate) AS VARCHAR) AS y, month(l_shipdate) AS m, CAST(l_linenumber AS VARCHAR) AS days, CAST(l_quantity AS INT) AS hours FROM lineitem),
    bins AS (SELECT *, CASE WHEN hours * 60 < 30 THEN '30分未満' WHEN hours * 60 < 60 THEN '30分~1時間未満' WHEN hours * 60 < 120 THEN '1~2時間未満'
        WHEN hours * 60 < 180 THEN '2~3時間未満' WHEN hours * 60 < 300 THEN '3~5時間未満' WHEN hours * 60 < 600 THEN '5~10時間未満'
        WHEN hours * 60 < 1200 THEN '10~20時間未満' ELSE '20時間以上' END AS bin FROM x),
    a AS (SELECT 'q5' AS q_key, flag AS label FROM bins UNION ALL SELECT 'q6', unnest(fs) FROM bins UNION ALL SELECT 'start-year', y FROM bins
        UNION ALL SELECT 'start-month', m || '月' FROM bins UNION ALL SELECT 'start-year-month', y || '-' || printf('%02d', m) FROM bins
        UNION ALL SELECT 'work-hours', '- 作業日数:' || days || '日' || chr(10) || '- 合計作業時間:' || hours || '時間' FROM bins
        UNION ALL SELECT 'work-days', days || '日' FROM bins UNION ALL SELECT 'work-minutes', bin FROM bins),
    n AS (SELECT count(*) AS total, count(*) FILTER (len(fs) > 0) AS answered, CAST(sum(len(fs)) AS BIGINT) AS picks FROM x)"""
O["q_assembled_freq"] = f"""WITH {ASSEMBLED}, f AS (SELECT q_key, label, count(*) AS count FROM a GROUP BY ALL)
    SELECT q_key, label, count, {pct("count", "CASE q_key WHEN 'q6' THEN answered ELSE total END")} AS percentage FROM f, n"""
O["q_assembled_questions"] = f"""WITH {ASSEMBLED}, q(q_ord, q_key, header, kind, chart, opt_order, derived) AS (VALUES
    (0, 'worker-id', '作業ID', 'ignore', 'none', 'count', '-'), (1, 'worker-name', '作業者', 'ignore', 'none', 'count', '-'),
    (2, 'worker-url', '作業者ページURL', 'ignore', 'none', 'count', '-'), (3, 'approved-at', '承認日時', 'ignore', 'none', 'count', '-'),
    (4, 'q5', '1. フラグ', 'single', 'pie', 'count', '-'), (5, 'q6', '2. 特徴', 'multiple', 'hbar', 'count', '-'),
    (6, 'start-year', '5. 仕事を受注・開始した年', 'single', 'bar', 'natural', '-'),
    (7, 'start-month', '6. 仕事を受注・開始した月', 'single', 'bar', 'preset', '-'),
    (8, 'work-hours', '11. 実際の作業時間', 'single', 'bar', 'preset', '-'),
    (9, 'start-year-month', '(派生) 年 + 月', 'single', 'line', 'natural', 'year-month'),
    (10, 'work-days', '(派生) 実際の作業時間 → 作業日数', 'single', 'bar', 'preset', 'work-days'),
    (11, 'work-minutes', '(派生) 実際の作業時間 → 合計作業時間', 'single', 'bar', 'preset', 'work-minutes'))
    SELECT CAST(q_ord AS BIGINT) AS q_ord, q_key, header, kind, chart, opt_order, derived,
        CASE WHEN kind = 'ignore' THEN 0 WHEN q_key = 'q6' THEN answered ELSE total END AS valid,
        CASE WHEN kind = 'ignore' THEN total WHEN q_key = 'q6' THEN total - answered ELSE 0 END AS blank,
        CASE WHEN kind = 'ignore' THEN 0 WHEN q_key = 'q6' THEN picks ELSE total END AS total_selections FROM q, n"""

O["q_crosstab_default_axes"] = f"""WITH {ASSEMBLED}, both_ AS (SELECT flag, fs FROM x WHERE len(fs) > 0),
    cell AS (SELECT flag, unnest(fs) AS f FROM both_)
    SELECT 'q5' AS row_key, 'q6' AS col_key, flag AS row_label, f AS col_label, count(*) AS count,
        (SELECT count(*) FROM both_ b WHERE b.flag = c.flag) AS row_total, (SELECT count(*) FROM cell d WHERE d.f = c.f) AS col_total,
        (SELECT count(*) FROM both_) AS grand_total FROM cell c GROUP BY flag, f"""

O["q_written_csv"] = f"""SELECT CASE WHEN section = 0 THEN chr(65279) || line ELSE line END AS line
    FROM ({O["q_summary_csv"]}) WHERE survey_id = 'orders'"""

ORACLES = O
