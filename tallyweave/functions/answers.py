"""From one cell to the list of options a respondent chose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tallyweave.constants import BRACKETS
from tallyweave.functions.text import (
    SEPARATOR, is_blank_norm, key_of, let, nfkc, protect, restore, squeeze,
)

_QUOTE = '"'
STRUCTURE = "[" + "".join("\\" + ch for ch in [*BRACKETS, *BRACKETS.values(), _QUOTE]) + "]"
_WRAPPED = '^(?:"[^"]*"|“[^"]*”)\\z'


def cutter():
    """A function (delimiters, text) -> pieces; delimiters in brackets or quotes do not cut."""
    # Everything the helper needs is local, so it travels to executors by value.
    openers, closers, quote = dict(BRACKETS), frozenset(BRACKETS.values()), _QUOTE
    patterns: dict[str, re.Pattern] = {}

    def cut(text: str, marks, quotes_count: bool) -> tuple[list[str], bool]:
        """Pieces between delimiters outside brackets and quotes; whether a quote stayed open."""
        pieces, start, depth, quoted = [], 0, 0, False
        for m in marks.finditer(text):
            ch = m.group()
            if ch == quote:
                quoted ^= quotes_count
            elif quoted:
                continue
            elif ch in openers:
                depth += 1
            elif ch in closers:
                depth -= depth > 0
            elif depth == 0:
                pieces.append(text[start : m.start()])
                start = m.end()
        pieces.append(text[start:])
        return pieces, quoted

    def pieces_of(delimiters: str, text: str) -> list[str]:
        if delimiters not in patterns:
            chars = [*delimiters, *openers, *closers, quote]
            patterns[delimiters] = re.compile("[" + "".join(map(re.escape, chars)) + "]")
        pieces, still_open = cut(text, patterns[delimiters], True)
        if still_open:
            # A quote that never closes is part of the text (5"monitor): it protects nothing.
            pieces, _ = cut(text, patterns[delimiters], False)
        return pieces

    return pieces_of


def _cutting():
    pieces_of, sep = cutter(), SEPARATOR

    def cut_cells(cells: pd.Series) -> pd.Series:
        def one(cell):
            if cell is None:
                return None
            return sep.join(pieces_of(*cell.split(sep, 1)))

        return cells.map(one)

    return F.pandas_udf(cut_cells, T.StringType())


_cut_structured = _cutting()


def cut_text(cell: Column, delimiters: Column, active: Column) -> Column:
    """Cell with SEPARATOR at each cut. Only active cells with brackets or quotes leave the JVM."""
    text = F.regexp_replace(cell, "\\r\\n?", "\n")
    marked = F.concat(F.array_join(delimiters, ""), F.lit(SEPARATOR), text)
    structured = _cut_structured(F.when(active & text.rlike(STRUCTURE), marked))
    any_of = F.concat(F.lit("[\\Q"), F.array_join(delimiters, ""), F.lit("\\E]"))
    pattern = F.when(F.size(delimiters) == 0, F.lit("(?!)")).otherwise(any_of)
    return F.coalesce(structured, F.regexp_replace(text, pattern, F.lit(SEPARATOR)))


def joined_text(cell: Column, delimiters: Column, is_multiple: Column) -> Column:
    """NFKC text of a cell; the pieces of a multiple-choice cell are joined by SEPARATOR.

    The text is protected: `values_of` restores each piece.
    """
    raw = protect(F.coalesce(cell, F.lit("")))
    return nfkc(F.when(is_multiple, cut_text(raw, delimiters, is_multiple)).otherwise(raw))


def values_of(joined: Column, unwraps: Column) -> Column:
    """Normalised, non-blank answers in a joined text, in cell order; may hold duplicates."""

    def value(v: Column) -> Column:
        inner = F.trim(F.substring(v, F.lit(2), F.length(v) - 2), F.lit(" \n"))
        return F.when(unwraps & v.rlike(_WRAPPED), inner).otherwise(v)

    values = F.transform(F.split(joined, SEPARATOR), lambda p: let(squeeze(restore(p)), value))
    return F.filter(values, lambda v: ~is_blank_norm(v))


def _first_by_key(options: Column) -> Column:
    def first(opts: Column, keys: Column) -> Column:
        kept = F.filter(opts, lambda o, i: F.array_position(keys, o["key"]) == i + 1)
        return F.when(F.size(F.array_distinct(keys)) == F.size(opts), opts).otherwise(kept)

    return let(
        options,
        lambda opts: let(F.transform(opts, lambda o: o["key"]), lambda keys: first(opts, keys)),
    )


ALIAS_INDEX = "map<string,struct<key:string,label:string>>"


def options_of(values: Column, alias_index: Column) -> Column:
    """Options as array<struct<key,label>>: alias applied, one entry per key, first wins.

    `alias_index` is map<key, struct<key,label>> or NULL.
    """
    index = alias_index.cast(ALIAS_INDEX)

    def option(v: Column) -> Column:
        return let(
            key_of(v),
            lambda k: F.coalesce(
                F.when(k != "", F.try_element_at(index, k)),
                F.struct(k.alias("key"), v.alias("label")),
            ),
        )

    mapped = F.transform(values, option)
    return _first_by_key(F.filter(mapped, lambda o: o["label"] != ""))


def split_answers(cell: Column, delimiters: Column) -> Column:
    """Distinct answers of a multiple-choice cell, first spelling kept."""
    joined = joined_text(cell, delimiters, F.lit(True))
    options = options_of(values_of(joined, F.size(delimiters) > 0), F.lit(None))
    return F.transform(options, lambda o: o["label"])
