"""Text normalisation, grouping keys, blank test and natural order.

Unicode NFKC has no Spark built-in. Full-width ASCII is folded with `translate`, and text made
only of characters that NFKC leaves alone never reaches Python; the rest goes through one
Arrow-batched helper. In Java regular expressions `\\s` is ASCII-only, so the white-space set
is spelled out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tallyweave.constants import BLANK_TOKEN_MAX, BLANK_TOKENS, HEADER_SYMBOLS, KEY_TAIL

_WS_REST = "\\t\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS = f"[\\n{_WS_REST}]"
INLINE_WS = f"[{_WS_REST}]+"

# Full-width ASCII block U+FF01..U+FF5E sits 0xFEE0 above its ASCII twin.
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000\u00A0"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "

# Unicode noncharacter that joins the fragments of a cell, so that one call normalises them all.
# `protect` hides it in input, behind another noncharacter and a digit.
SEPARATOR = "\uFDD0"
HIDDEN = "\uFDD2"

# Ranges whose characters NFKC maps to themselves and never composes with one another.
INERT_RANGES = (
    (0x00, 0x7F),      # ASCII
    (0xC0, 0xFF),      # Latin letters with accents
    (0x2010, 0x2010),  # hyphen
    (0x2013, 0x2014),  # dashes
    (0x2018, 0x201D),  # quotation marks
    (0x203B, 0x203B),  # reference mark
    (0x3001, 0x3003),  # ideographic punctuation
    (0x3005, 0x301C),  # brackets, iteration mark, wave dash
    (0x3041, 0x3096),  # hiragana
    (0x309D, 0x309E),
    (0x30A1, 0x30FE),  # katakana
    (0x4E00, 0x9FFF),  # CJK ideographs
    (0xFDD0, 0xFDD2),  # noncharacters, SEPARATOR among them
)
_FOLDABLE = ((0xFF01, 0xFF5E), (0x3000, 0x3000), (0xA0, 0xA0))
_NATIVE = "^[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in INERT_RANGES + _FOLDABLE) + "]*\\z"


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression, so that reuse does not multiply the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def protect(c: Column) -> Column:
    """Text without SEPARATOR, from which `restore` makes the original again."""
    escaped = F.replace(F.replace(c, F.lit(HIDDEN), F.lit(HIDDEN + "2")), F.lit(SEPARATOR), F.lit(HIDDEN + "0"))
    return F.when(c.rlike(f"[{SEPARATOR}{HIDDEN}]"), escaped).otherwise(c)


def restore(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit(HIDDEN + "0"), F.lit(SEPARATOR)), F.lit(HIDDEN + "2"), F.lit(HIDDEN))
    return F.when(c.contains(HIDDEN), plain).otherwise(c)


@F.pandas_udf(T.StringType())
def _nfkc_rest(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t else None)


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Python sees only text with characters outside the native ranges."""
    rest = F.regexp_replace(c, _NATIVE, "")
    return F.coalesce(_nfkc_rest(rest), F.translate(c, _WIDE, _NARROW))


def squeeze(c: Column) -> Column:
    """White-space rules of a normalised text: single inline spaces, LF line ends, trimmed."""

    def rules(t: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(t, "\\r\\n?", "\n"), INLINE_WS, " ")
        return F.trim(F.regexp_replace(spaced, " *\\n *", "\n"), F.lit(" \n"))

    # Most answers hold no white space at all; one test then replaces all rules.
    return let(c, lambda t: F.when(t.rlike(WS), rules(t)).otherwise(t))


def norm_text(c: Column) -> Column:
    return squeeze(nfkc(F.coalesce(c, F.lit(""))))


def key_of(normalised: Column) -> Column:
    """Grouping key of an already normalised text."""
    t = F.regexp_replace(F.lower(normalised), f"[{KEY_TAIL}]+\\z", "")
    return F.trim(t, F.lit(" \n"))


def norm_key(c: Column) -> Column:
    return key_of(norm_text(c))


def norm_header(c: Column) -> Column:
    """Key without white space and bracket/punctuation symbols, for header matching."""
    symbols = "[" + "".join("\\" + s for s in HEADER_SYMBOLS) + "]"
    return F.regexp_replace(F.regexp_replace(norm_key(c), WS + "+", ""), symbols, "")


def is_blank_norm(normalised: Column) -> Column:
    """Blank test on an already normalised text."""
    return F.lower(normalised).isin("", *BLANK_TOKENS)


ANSWERED = "answered text"
_PROBE = 64


def shorten_long(c: Column) -> Column:
    """Replace a cell that is surely an answer by a fixed text; only for blank tests.

    NFKC never shortens text to ASCII or dashes, so a cell whose first characters already hold
    more visible ones than the longest blank token is an answer and needs no normalising.
    """
    raw = F.coalesce(c, F.lit(""))
    visible = F.length(F.regexp_replace(F.substring(raw, 1, _PROBE), WS + "+", ""))
    return F.when(visible > BLANK_TOKEN_MAX, F.lit(ANSWERED)).otherwise(raw)


def is_blank(c: Column) -> Column:
    return is_blank_norm(norm_text(shorten_long(c)))


def natural_key(label: Column) -> Column:
    """Sort key for natural order: numbers by value, other runs by Japanese collation."""
    digits = F.regexp_replace(nfkc(label), "(?<=[0-9]),(?=[0-9])", "")
    tokens = F.regexp_extract_all(digits, F.lit("([0-9]+(?:\\.[0-9]+)?|[^0-9]+)"), 1)

    def comparable(t: Column) -> Column:
        whole = F.regexp_replace(F.split_part(t, F.lit("."), F.lit(1)), "^0+(?=.)", "")
        # A length prefix orders whole parts by magnitude whatever their size.
        number = F.concat(
            F.lpad(F.length(whole).cast("string"), 6, "0"),
            F.lit(" "),
            whole,
            F.lit("."),
            F.regexp_replace(F.split_part(t, F.lit("."), F.lit(2)), "0+\\z", ""),
        )
        return F.collate(F.when(t.rlike("^[0-9]"), number).otherwise(t), "ja")

    return F.transform(tokens, comparable)


def natural_order(label: Column, key: Column | None = None) -> list[Column]:
    """Order-by list: natural key, then Japanese collation, then code points as a last tie.

    Pass the key as a stored column where the sort runs in a window or a range partitioning.
    """
    key = natural_key(label) if key is None else key
    return [key.asc(), F.collate(label, "ja").asc(), label.asc()]
