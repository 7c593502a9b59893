"""Question kind inference for every column of every survey in one pass.

Cells repeat a lot, so each batch of responses counts its equal cells first and examines each
distinct text once. What leaves a batch are keys and tokens with the numbers of cells that have
them, as digests when those are shorter; they are added up map-side and shuffled once. Distinct
counts are exact: distinct values and tokens are rows of a grouping before they are counted.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave import constants as K
from tallyweave.functions.answers import STRUCTURE, cutter
from tallyweave.functions.text import HIDDEN, INLINE_WS, SEPARATOR

# Keys and tokens up to this length are grouped by their text, longer ones by a digest. Cells up
# to this length are looked up among those a task has examined before.
SHORT_CELL = 64
_REMEMBERED = 100_000
_ROWS_PER_BATCH = 50_000
# What a counted text is; bits, as one text may be the key of cells and a token of cells.
_KEY, _TOKEN = 1, 2
_FLAGS = ("filled", "multiline", "parsed", "split_rows")


def _examiner(limit: int):
    """A function of a cell: its key (NULL if blank), its flags, and its distinct tokens' keys.

    The rules are those of `functions.text` and `functions.answers`, here on Python strings.
    """
    blanks, tail = frozenset(("", *K.BLANK_TOKENS)), K.KEY_TAIL
    delimiters = "".join(K.SAFE_DELIMITERS)
    pieces_of, separator, hidden = cutter(), SEPARATOR, HIDDEN
    inline, around, digit = re.compile(INLINE_WS), re.compile(" *\n *"), re.compile("[0-9]")
    structure, marks = re.compile(STRUCTURE), re.compile("[" + re.escape(delimiters) + "]")
    wrapped = re.compile('(?:"[^"]*"|“[^"]*”)\\Z')
    normal, sha256 = unicodedata.normalize, hashlib.sha256

    def squeezed(raw: str) -> str:
        """As `squeeze`, but for the ends, and in lower case."""
        text = normal("NFKC", raw)
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        text = inline.sub(" ", text)
        return (around.sub("\n", text) if "\n" in text else text).lower()

    def short(text: str) -> bytes:
        raw = text.encode()
        # No key begins with a line feed.
        return b"\n" + sha256(raw).digest() if len(text) > limit else raw

    def key_of(lowered: str) -> str:
        return lowered.rstrip(tail).strip(" \n")

    def tokens_of(raw: str) -> set[str]:
        known = separator in raw or hidden in raw
        if known:
            raw = raw.replace(hidden, hidden + "2").replace(separator, hidden + "0")
        if "\r" in raw:
            raw = raw.replace("\r\n", "\n").replace("\r", "\n")
        cut = pieces_of(delimiters, raw) if structure.search(raw) else marks.split(raw)
        tokens = set()
        # Nothing is composed, squeezed or cased across a separator.
        for piece in squeezed(separator.join(cut)).split(separator):
            piece = piece.strip(" \n")
            if known:
                piece = piece.replace(hidden + "0", separator).replace(hidden + "2", hidden)
            if piece[:1] in ('"', "“") and wrapped.match(piece):
                piece = piece[1:-1].strip(" \n")
            if piece not in blanks:
                tokens.add(key_of(piece))
        return tokens

    def examine(raw: str) -> tuple[bytes | None, tuple[bool, ...], list[bytes], int]:
        """Key, flags, tokens other than the key, and what the key's text is."""
        text = squeezed(raw).strip(" \n")
        if text in blanks:
            return None, (False,) * 4, [], _KEY
        key = key_of(text)
        plain = text[0] not in '"“' and not marks.search(raw) and not structure.search(raw)
        tokens = {key} if plain else tokens_of(raw)
        flags = (True, "\n" in raw, digit.search(text) is not None, len(tokens) >= 2)
        part = _KEY | _TOKEN if key in tokens else _KEY
        return short(key), flags, [short(t) for t in tokens if t != key], part

    return examine


def _counted_cells(batch: pa.RecordBatch) -> pa.Table:
    """(survey, col_idx, cell, n) of a batch of responses; null cells are empty."""
    cells = batch.column("cells")
    parents = pc.list_parent_indices(cells)
    rows = parents.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    flat = pa.table(
        {
            "survey_id": pc.take(batch.column("survey_id"), parents),
            "col_idx": pa.array(place, pa.int32()),
            "cell": pc.fill_null(pc.list_flatten(cells), ""),
        }
    )
    return flat.group_by(["survey_id", "col_idx", "cell"]).aggregate([([], "count_all")])


def _texts(cells: pa.ChunkedArray) -> list[str]:
    try:
        return cells.to_pylist()
    except UnicodeDecodeError:
        return [c.decode("utf-8", "replace") for c in cells.cast(pa.binary()).to_pylist()]


def _found(limit: int, schema: pa.Schema):
    """Rows for the keys and tokens of batches of responses, with the cells that have each flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examine, remembered = _examiner(limit), {}
        for batch in batches:
            counted = _counted_cells(batch)
            for part in counted.to_batches(_ROWS_PER_BATCH):
                rows = [[] for _ in schema]
                survey, column, value, role, *flags = rows
                cells = pa.chunked_array([part.column("cell")])
                texts, numbers = _texts(cells), part.column("count_all").to_pylist()
                for i, (text, n) in enumerate(zip(texts, numbers)):
                    seen = remembered.get(text)
                    if seen is None:
                        seen = examine(text)
                        if len(text) <= limit:
                            if len(remembered) >= _REMEMBERED:
                                remembered.clear()
                            remembered[text] = seen
                    key, own, others, what = seen
                    survey.append(i)
                    value.append(key)
                    role.append(what)
                    for into, flag in zip(flags, own):
                        into.append(n if flag else 0)
                    if others:
                        more = len(others)
                        survey += [i] * more
                        value += others
                        role += [_TOKEN] * more
                        for into in flags:
                            into += [0] * more
                    if len(value) >= _ROWS_PER_BATCH:
                        yield _batch(part, rows, schema)
                        for into in rows:
                            into.clear()
                if value:
                    yield _batch(part, rows, schema)

    def _batch(part: pa.RecordBatch, rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        at = pa.array(rows[0], pa.int64())
        own = [pc.take(part.column("survey_id"), at), pc.take(part.column("col_idx"), at)]
        made = [pa.array(r, f.type) for r, f in zip(rows[2:], list(schema)[2:])]
        return pa.RecordBatch.from_arrays([*own, *made], schema=schema)

    return run


def column_profile(responses: DataFrame) -> DataFrame:
    """Counters per (survey_id, col_idx) over non-blank cells."""
    column = ["survey_id", "col_idx"]
    fields = [("col_idx", pa.int32()), ("value", pa.binary()), ("part", pa.int32())]
    fields += [(name, pa.int64()) for name in _FLAGS]
    schema = pa.schema([("survey_id", pa.string()), *fields])
    cells = responses.select(F.col("survey_id").cast("string").alias("survey_id"), "cells")
    made = "survey_id string, col_idx int, value binary, part int, " + ", ".join(f"{name} bigint" for name in _FLAGS)
    rows = cells.mapInArrow(_found(SHORT_CELL, schema), made)
    values = rows.groupBy(*column, "value").agg(F.bit_or("part").alias("part"), *[F.sum(name).alias(name) for name in _FLAGS])
    is_a = lambda part: F.col("part").bitwiseAND(part) > 0
    return values.groupBy(*column).agg(
        *[F.sum(name).alias(name) for name in _FLAGS],
        F.count_if(is_a(_KEY) & F.col("value").isNotNull()).alias("distinct_values"),
        F.count_if(is_a(_TOKEN)).alias("distinct_tokens"),
    )


def kind_rule() -> Column:
    """First matching rule wins: empty, numeric, multiple, single, else free text."""
    filled = F.col("filled")
    ratio = lambda name: F.col(name) / F.nullif(filled, F.lit(0))
    numeric = (
        (ratio("multiline") < K.MULTILINE_MAX_RATIO)
        & (ratio("parsed") >= K.NUMERIC_MIN_RATIO)
        & (F.col("distinct_values") > K.NUMERIC_DISTINCT_ABOVE)
    )
    multiple = (ratio("split_rows") >= K.MULTIPLE_MIN_SPLIT_RATIO) & (
        F.col("distinct_tokens") <= K.MULTIPLE_MAX_TOKENS
    )
    single = (F.col("distinct_values") <= K.SINGLE_MAX_DISTINCT) & (
        ratio("distinct_values") <= K.SINGLE_MAX_DISTINCT_RATIO
    )
    return (
        F.when(filled == 0, "ignore")
        .when(numeric, "numeric")
        .when(multiple, "multiple")
        .when(single, "single")
        .otherwise("free")
    )


def infer_kinds(responses: DataFrame) -> DataFrame:
    """(survey_id, col_idx, counters, kind, chart) for every column."""
    pie = F.col("distinct_values") <= K.PIE_MAX_DISTINCT
    chart = (
        F.when(F.col("kind") == "numeric", "bar")
        .when(F.col("kind") == "multiple", "hbar")
        .when(F.col("kind") == "single", F.when(pie, "pie").otherwise("bar"))
        .otherwise("none")
    )
    return column_profile(responses).withColumn("kind", kind_rule()).withColumn("chart", chart)
