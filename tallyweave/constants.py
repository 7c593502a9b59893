"""Fixed values that decide results: tokens, delimiters, units, labels, thresholds."""

from __future__ import annotations

# ---- fixed values: text ----------------------------------------------------------------
# Lower-cased, normalised cells that count as "no answer".
BLANK_TOKENS = ("-", "‐", "—", "n/a", "na", "null", "undefined")
# Longest blank token; a cell with more visible characters is always an answer.
BLANK_TOKEN_MAX = max(len(t) for t in BLANK_TOKENS)
# Punctuation stripped from the end of a grouping key.
KEY_TAIL = "。、．，.,"
# Symbols a header loses before it is matched against profiles.
HEADER_SYMBOLS = "【】（）()「」『』［］[]・、。，．,.-_/＼\\？?：:＊*※"

# ---- fixed values: multiple answers ------------------------------------------------------
SAFE_DELIMITERS = ("\n", ",", "、", ";", "；", "|", "｜")
DEFAULT_DELIMITERS = SAFE_DELIMITERS + ("/", "・")
BRACKETS = {"(": ")", "（": "）", "【": "】", "「": "」", "『": "』"}

# ---- fixed values: numerals --------------------------------------------------------------
SCALES = {"億": 100_000_000, "万": 10_000, "千": 1_000}
RANGE_SEPARATORS = ("〜", "～", "~", "から", "-", "−", "‐", "–", "—")
HOUR_UNIT = "時間"
NICE_MANTISSAS = (1, 2, 5)
MAX_BIN_CANDIDATES = 400
DISCRETE_BIN_LIMIT = 10
RANGE_MARK = "〜"
# Possessive quantifiers keep a numeral whole: "35万" never yields a bare "3".
NUMERAL = "([0-9]++(?:\\.[0-9]++)?+)"
CALENDAR_DATE = "^[0-9]{4}[-/.][0-9]{1,2}(?:[-/.][0-9]{1,2})?\\z"
HOURS_TEXT = "(?i)([0-9]+(?:\\.[0-9]+)?)(?:時間|時|hours?|hrs?|h)"
MINUTES_TEXT = "(?i)([0-9]+(?:\\.[0-9]+)?)(?:分|minutes?|mins?|m(?![a-z]))"

# ---- fixed values: work time -------------------------------------------------------------
UNPARSED = "解析不能"
DAYS_LABEL = "作業日数"
MINUTES_LABEL = "合計作業時間"
KANJI_DIGITS = "一二三四五六七八九十"
APPROXIMATE_HEAD = "^(?:約|およそ|おおよそ|ほぼ)[ \\n]*"
APPROXIMATE_TAIL = "(?:ほど|程度|程|くらい|ぐらい|位)\\z"
# (upper bound in minutes, label); the last bin has no upper bound.
DURATION_BINS = (
    (30, "30分未満"),
    (60, "30分~1時間未満"),
    (120, "1~2時間未満"),
    (180, "2~3時間未満"),
    (300, "3~5時間未満"),
    (600, "5~10時間未満"),
    (1200, "10~20時間未満"),
    (None, "20時間以上"),
)
DAYS_PRESET = tuple(f"{d}日" for d in range(1, 32)) + (UNPARSED,)
MINUTES_PRESET = tuple(label for _, label in DURATION_BINS) + (UNPARSED,)

# ---- fixed values: kind inference --------------------------------------------------------
NUMERIC_MIN_RATIO = 0.9
MULTILINE_MAX_RATIO = 0.3
NUMERIC_DISTINCT_ABOVE = 12
MULTIPLE_MIN_SPLIT_RATIO = 0.15
MULTIPLE_MAX_TOKENS = 40
SINGLE_MAX_DISTINCT = 30
SINGLE_MAX_DISTINCT_RATIO = 0.6
PIE_MAX_DISTINCT = 6

# Chart of a question whose kind was changed by hand.
KINDS_CHART = {"multiple": "hbar", "single": "bar", "numeric": "bar", "free": "none", "ignore": "none"}

# ---- fixed values: reports ---------------------------------------------------------------
FREE_SAMPLE_ROWS = 20
FREE_SAMPLE_CHARS = 200
LISTING_ROWS = 200
LISTING_CHARS = 40
TOTAL_LABEL = "合計(実人数)"
FREE_PLACEHOLDER = "(自由記述)"
EMPTY_PLACEHOLDER = "(回答なし)"

# ---- fixed values: platform export layout ------------------------------------------------
# Number, optional branch number, question text: "1. Age", "12-3. Tools used".
NUMBERED_HEADER = "^\\s*([0-9]+)(?:\\s*-\\s*([0-9]+))?\\s*[.．]\\s*(.*)\\z"
UNNAMED_COLUMN = "列"
MANAGEMENT_HEADERS = ("作業ID", "作業者", "作業者ページURL", "承認日時")
IDENTITY_KINDS = ("worker-name", "worker-url", "worker-id", "approved-at")
VISIBLE_BY_DEFAULT = ("approved-at",)

# ---- fixed values: file sniffing ---------------------------------------------------------
FILE_DELIMITERS = ("\t", ",", ";", "|")
SNIFF_LINES = 10
