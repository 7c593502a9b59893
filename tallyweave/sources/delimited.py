"""Reading survey exports: delimited files of any size, each with its own encoding and delimiter.

Files are read as lines of bytes, so that Spark can split a large one over many tasks. Whether a
line end lies inside a quoted cell depends on everything before it, but a stretch of lines only
turns one of two states (outside or inside a quoted cell) into another. A first scan works that
out per input split and delimiter, together with the encoding and the delimiter counts of the
split's first lines; the few results are chained in file order, and a second scan knows for each
split in which state it begins. Only records that span splits are moved to be joined.

A quote opens a cell only where a cell starts (5"monitor is plain text), and a doubled quote
inside a quoted cell is one quote. Line ends inside cells are kept as they are.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from statistics import pvariance

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyweave.constants import BLANK_TOKENS, FILE_DELIMITERS, SNIFF_LINES
from tallyweave.functions.text import norm_text
from tallyweave.model import Survey, traits_of
from tallyweave.operators.inference import infer_kinds
from tallyweave.operators.joins import grown_join, is_small
from tallyweave.operators.questions import build_questions
from tallyweave.profiles import DEFAULT_PROFILES
from tallyweave.session import pin
from tallyweave.sources.layout import fold_paired, named_columns

SPLIT = ["survey_id", "split"]
# A split's row is about 150 bytes, so a broadcast stays near 40 MB.
BROADCAST_SPLITS = 250_000
_PIECE = re.compile(r'"[^"]*(?:"|\Z)|\r\n|\r|\n|[^"\r\n]+')
_BOM = b"\xef\xbb\xbf"
# Rows that Python hands on at once, and bytes of lines.
_BATCH, _BATCH_BYTES = 4096, 1 << 22


def sniff_delimiter(text: str) -> str:
    """Delimiter with the steadiest count per line among those found at least once a line.

    Looks at the first non-blank lines; quoted stretches hide delimiters and line ends.
    """
    lines: list[str] = []
    line = ""

    def keep() -> None:
        if line.strip(_BLANKS):
            lines.append(line)

    for piece in _PIECE.finditer(text):
        part = piece.group()
        if part in ("\r\n", "\r", "\n"):
            keep()
            line = ""
            if len(lines) == SNIFF_LINES:
                break
        else:
            line += "q" if part.startswith('"') else part
    else:
        keep()
    return _steadiest([[ln.count(d) for d in FILE_DELIMITERS] for ln in lines])


def _steadiest(lines: list[list[int]]) -> str:
    """The delimiter, from how often each occurs in every line."""
    best, least = ",", float("inf")
    for delimiter, counts in zip(FILE_DELIMITERS, zip(*lines)):
        if counts and sum(counts) >= len(counts) and pvariance(counts) < least - 1e-9:
            best, least = delimiter, pvariance(counts)
    return best


_STOP = re.compile(r'"|\r\n|\r|\n')
_BLANKS = " 　"


class Head:
    """The first lines of a stretch of text that begins outside or inside quotes.

    A line, or a part of one, is a list: whether it is filled, and how often each delimiter occurs
    in it. `first` is what precedes the first line end (None without one), `lines` the filled whole
    lines after it, `last` what follows the last line end. Stretches are joined by `sniff_heads`.
    """

    def __init__(self, inside: bool):
        self.inside, self.first, self.lines, self.last = inside, None, [], self._empty()

    @staticmethod
    def _empty() -> list[int]:
        return [0] * (1 + len(FILE_DELIMITERS))

    @property
    def full(self) -> bool:
        return len(self.lines) >= SNIFF_LINES

    def feed(self, text: str) -> None:
        at = 0
        while not self.full:
            if self.inside:
                at = text.find('"', at) + 1
                if not at:
                    return
                self.inside = False
            stop = _STOP.search(text, at)
            plain = text[at : stop.start() if stop else len(text)]
            if plain:
                self.last[0] |= bool(plain.strip(_BLANKS))
                for i, delimiter in enumerate(FILE_DELIMITERS, 1):
                    self.last[i] += plain.count(delimiter)
            if not stop:
                return
            at = stop.end()
            if stop.group() == '"':
                self.last[0], self.inside = 1, True
                continue
            if self.first is None:
                self.first = self.last
            elif self.last[0]:
                self.lines.append(self.last)
            self.last = self._empty()

    def copy(self) -> Head:
        made = Head(self.inside)
        made.first, made.lines, made.last = self.first and [*self.first], [[*ln] for ln in self.lines], [*self.last]
        return made

    def row(self) -> dict:
        return {"first": self.first, "lines": self.lines, "last": self.last}


def sniff_heads(heads: list[dict]) -> str:
    """The delimiter of a file from the heads of its splits, in order."""
    lines, begun = [], Head._empty()
    for head in heads:
        if head["first"] is None:
            begun = _together(begun, head["last"])
            continue
        lines += [line for line in (_together(begun, head["first"]), *head["lines"]) if line[0]]
        begun = head["last"]
        if len(lines) >= SNIFF_LINES:
            break
    if begun[0]:
        lines.append(begun)
    return _steadiest([line[1:] for line in lines[:SNIFF_LINES]])


def _together(one: list[int], two: list[int]) -> list[int]:
    return [one[0] | two[0], *(a + b for a, b in zip(one[1:], two[1:]))]


# White space as in functions.text.WS.
_WS = "\t\n\v\f\r       　﻿" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def _blank(cell: str) -> bool:
    text = unicodedata.normalize("NFKC", cell).strip(_WS).lower()
    return text == "" or text in BLANK_TOKENS


# ---- quote state ----------------------------------------------------------------------------


class Quotes:
    """Where records end in a stretch of whole lines."""

    def __init__(self, delimiter: str):
        mark = re.escape(delimiter.encode())
        self._opening = re.compile(rb'(?:(?<=[\r\n])|(?<=' + mark + rb')|\A)"')
        self._rest = re.compile(rb'(?:[^"]|"")*')

    def scan(self, text: bytes, inside: bool) -> tuple[bool, int, int]:
        """State at the end, and the ends of the first and the last line that ends a record.

        The text begins at a line's start, inside a quoted cell or not, and ends with a line
        end; -1 stands for no such line.
        """
        first = last = -1
        at, end = 0, len(text)
        while True:
            if inside:
                # Up to the quote that is not doubled; the cell goes on as plain text after it.
                at = self._rest.match(text, at).end()
                if at == end:
                    return True, first, last
                at, inside = at + 1, False
            found = self._opening.search(text, at)
            stop = found.start() if found else end
            if first < 0:
                first = text.find(b"\n", at, stop) + 1 or -1
            last = max(last, text.rfind(b"\n", at, stop) + 1 or -1)
            if not found:
                return False, first, last
            at, inside = found.end(), True


# ---- lines and splits -----------------------------------------------------------------------


def _relative(path: str) -> Column:
    """A file's path below the folder that is read; its name when the file itself is, and its full
    path when a pattern is."""
    # A plus sign is not a blank in a path.
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    if re.search(r"[*?\[{]", path):
        return full
    root = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/") + "/"
    at = F.locate(root, full)
    below = F.substring(full, at + F.lit(len(root)), F.length(full))
    return F.when(at > 0, below).otherwise(F.regexp_extract(full, "([^/]+)$", 1))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(survey_id, split, at, line, size) of all files under a path; lines as bytes.

    `split` is where the input split begins in its file; its lines arrive together, in order.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return lines.select(
        _relative(path).alias("survey_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_size").alias("size"),
    )


def cut_contents(batches: Iterator[pa.RecordBatch], lines_per_split: int) -> Iterator[pa.RecordBatch]:
    """The lines of whole files. Small files share a batch; a large one is handed on in several."""
    names = ["survey_id", "split", "at", "line", "size"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    rows: list[list] = [[] for _ in names]
    held = 0

    def batch_of_rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names)
        rows[:] = [[] for _ in names]
        return made

    for batch in batches:
        for survey_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            content = content or b""
            body = content.removeprefix(_BOM)
            lines = body.split(b"\n")
            lines = lines[:-1] if body.endswith(b"\n") else lines if body else []
            for first in range(0, len(lines), lines_per_split):
                part = lines[first : first + lines_per_split]
                n = len(part)
                for column, values in zip(rows, ([survey_id] * n, [first] * n, range(first, first + n), part, [len(content)] * n)):
                    column.extend(values)
                held += sum(map(len, part))
                if len(rows[0]) >= _BATCH or held >= _BATCH_BYTES:
                    yield batch_of_rows()
                    held = 0
    if rows[0]:
        yield batch_of_rows()


def content_lines(contents: DataFrame, lines_per_split: int = 10_000) -> DataFrame:
    """The same from (survey_id, content BINARY) rows, one row per file."""
    schema = "survey_id string, split bigint, at bigint, line binary, size bigint"
    return contents.select("survey_id", "content").mapInArrow(lambda found: cut_contents(found, lines_per_split), schema)


def _split_runs(batches: Iterator[pa.RecordBatch], more: tuple[str, ...]) -> Iterator[tuple[tuple, bool, list[bytes]]]:
    """(split key and further columns, whether it begins, lines) for stretches of one split."""
    current = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in (*SPLIT, *more)]))
        lines = batch.column("line").to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i][:2] != keys[start][:2]:
                yield keys[start], keys[start][:2] != current, lines[start:i]
                current, start = keys[start][:2], i


_ENCODINGS = ("utf-8", "cp932")


def _profile_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanners = [Quotes(d) for d in FILE_DELIMITERS]
    names = ["survey_id", "split", "size", "bytes", "valid", "cr", "odd", "ends", "heads"]
    rows: list = []

    def finish() -> dict:
        heads = [[_stored(h) for h in both] for both in state["heads"]]
        found = (state[n] for n in ("bytes", "valid", "cr", "odd", "ends"))
        return dict(zip(names, (*state["key"], *found, heads)))

    state: dict = {}
    for key, begins, lines in _split_runs(batches, ("size",)):
        if begins:
            if state:
                rows.append(finish())
            # A file begins outside quotes, so its first split needs one head only.
            begins_in = (False, True) if key[1] else (False,)
            state = {"key": key, "bytes": 0, "valid": True, "cr": False, "odd": False,
                     "ends": [[False, True] for _ in FILE_DELIMITERS],
                     "heads": [[Head(inside) for inside in begins_in]] * len(_ENCODINGS), "ascii": True}
        text = b"\n".join(lines) + b"\n"
        state["bytes"] += len(text)
        state["cr"] = lines[-1].endswith(b"\r")
        ascii_only = text.isascii()
        if state["valid"] and not ascii_only:
            try:
                text.decode("utf-8")
            except UnicodeDecodeError:
                state["valid"] = False
        # ASCII reads alike in both encodings, so their heads are the same ones until other bytes come.
        if state["ascii"] and not ascii_only:
            state["heads"], state["ascii"] = [state["heads"][0], [h.copy() for h in state["heads"][0]]], False
        for encoding, heads in list(zip(_ENCODINGS, state["heads"]))[: 1 if state["ascii"] else None]:
            _feed(heads, lines, encoding, b'"' in text)
        if b'"' in text:
            state["odd"] ^= text.count(b'"') % 2 == 1
            for scanner, ends in zip(scanners, state["ends"]):
                ends[:] = [scanner.scan(text, s)[0] for s in ends]
        if len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, _PROFILE)
            rows = []
    if state:
        rows.append(finish())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _PROFILE)


def _stored(head: Head) -> dict:
    """A head as a row: the whole lines in it, whether it says anything, and itself as text."""
    found = head.row()
    whole = len(found["lines"]) + (found["first"][0] if found["first"] else 0)
    return {"whole": whole, "telling": found["first"] is not None or found["last"][0] == 1, "text": json.dumps(found)}


def _feed(heads: list[Head], lines: list[bytes], encoding: str, quoted: bool) -> None:
    """Show lines to heads until all are full; without a quote nothing changes inside of one."""
    for line in lines:
        open_heads = [h for h in heads if not h.full and (quoted or not h.inside)]
        if not open_heads:
            return
        text = line.decode(encoding, errors="replace") + "\n"
        for head in open_heads:
            head.feed(text)


_HEAD = pa.struct([("whole", pa.int64()), ("telling", pa.bool_()), ("text", pa.string())])
_PROFILE = pa.schema(
    [("survey_id", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("valid", pa.bool_()),
     ("cr", pa.bool_()), ("odd", pa.bool_()), ("ends", pa.list_(pa.list_(pa.bool_()))), ("heads", pa.list_(pa.list_(_HEAD)))]
)
_HEAD_SQL = "struct<whole: bigint, telling: boolean, text: string>"
_PROFILE_SQL = f"""survey_id string, split bigint, size bigint, bytes bigint, valid boolean, cr boolean, odd boolean,
                  ends array<array<boolean>>, heads array<array<{_HEAD_SQL}>>"""


def _sniff_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sniff_heads([json.loads(head) for head in heads]) for heads in batch.column("heads").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("survey_id"), pa.array(found, pa.string())], ["survey_id", "delimiter"])


def _delimiters(found: DataFrame) -> DataFrame:
    """(survey_id, delimiter) from the heads of as many splits as hold the lines to look at."""
    order = Window.partitionBy("survey_id").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.count_if("odd").over(earlier), F.lit(0)) % 2
    valid = F.min("valid").over(Window.partitionBy("survey_id"))
    heads = found.withColumns({"_inside": inside.cast("int"), "_bytes": F.when(valid, 0).otherwise(1)})
    heads = heads.select(*SPLIT, F.get(F.get("heads", F.col("_bytes")), F.col("_inside")).alias("head"))
    # Splits within a quoted cell, or of blank lines, say nothing.
    seen = F.coalesce(F.sum("head.whole").over(earlier), F.lit(0))
    heads = heads.where("head.telling").withColumn("_seen", seen).where(F.col("_seen") < SNIFF_LINES)
    listed = F.array_sort(F.collect_list(F.struct("split", "head")), lambda x, y: F.when(x["split"] < y["split"], -1).otherwise(1))
    listed = heads.groupBy("survey_id").agg(F.transform(listed, lambda h: h["head"]["text"]).alias("heads"))
    return listed.mapInArrow(_sniff_files, "survey_id string, delimiter string")


def profile_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, splits): encoding, delimiter and end of every file; the state before every split."""
    found = pin(lines.mapInArrow(_profile_splits, _PROFILE_SQL))
    # Line ends are one byte each, a byte order mark is three and already gone.
    extra = F.max("size") - F.sum("bytes")
    files = found.groupBy("survey_id").agg(
        F.min("valid").alias("utf8"),
        extra.isin(0, 3).alias("ends_lf"),
        F.max_by("cr", "split").alias("ends_cr"),
    )
    files = grown_join(files, _delimiters(found), "survey_id", "left").select(
        "survey_id", "utf8", "ends_lf", (F.col("ends_lf") | F.col("ends_cr")).alias("blank_end"),
        F.coalesce("delimiter", F.lit(",")).alias("delimiter"),
    )
    files = pin(files)
    number = F.array_position(F.array(*[F.lit(d) for d in FILE_DELIMITERS]), F.col("delimiter")).cast("int") - 1
    chained = grown_join(found, files, "survey_id").withColumn("turn", F.get("ends", number))
    # A stretch that ends alike from both states decides; otherwise it keeps the state or turns it.
    order = Window.partitionBy("survey_id").orderBy("split")
    outside, inside = F.get("turn", F.lit(0)), F.get("turn", F.lit(1))
    decided = F.when(outside == inside, F.col("split"))
    chained = chained.withColumn("_since", F.coalesce(F.last(decided, True).over(order), F.lit(-1)))
    run = Window.partitionBy("survey_id", "_since").orderBy("split")
    base = F.first(F.when(outside == inside, outside).otherwise(F.lit(False))).over(run)
    turns = F.sum(F.when((outside != inside) & outside, 1).otherwise(0)).over(run)
    chained = chained.withColumn("_after", base != (turns % 2 == 1))
    splits = chained.select(
        *SPLIT, "delimiter", "utf8", F.coalesce(F.lag("_after").over(order), F.lit(False)).alias("inside"),
        F.col("_after").alias("stays_open"),
    )
    return files, pin(splits)


# ---- records --------------------------------------------------------------------------------

_RECORDS = "survey_id string, split bigint, n bigint, cells array<string>, first_filled int, piece binary"
_RECORD_SCHEMA = pa.schema(
    [("survey_id", pa.string()), ("split", pa.int64()), ("n", pa.int64()), ("cells", pa.list_(pa.string())),
     ("first_filled", pa.int32()), ("piece", pa.binary())]
)
# Numbers of pieces: the end of a record begun in an earlier split, all of a split inside one, and
# the beginning of a record that goes on in the next split.
_ENDED, _INSIDE, _BEGUN = -1, -2, -3


def _tokens(text: bytes, delimiter: str, utf8: bool) -> Iterator[tuple[list[str], int | None]]:
    """Cells of whole records, and the number of the first cell that is not blank."""
    # A quoted cell may be as long as its file.
    csv.field_size_limit(sys.maxsize)
    decoded = text.decode("utf-8" if utf8 else "cp932", errors="replace")
    for cells in csv.reader(io.StringIO(decoded, newline=""), delimiter=delimiter):
        yield cells, next((i for i, c in enumerate(cells) if not _blank(c)), None)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie in one split; what is left of others as pieces, in order."""
    rows: list[dict] = []
    scanners = {d: Quotes(d) for d in FILE_DELIMITERS}

    def row(n, cells=None, filled=None, piece=None):
        rows.append({"survey_id": key[0], "split": key[1], "n": n, "cells": cells, "first_filled": filled, "piece": piece})

    def rest() -> None:
        nonlocal held
        if held:
            row(_INSIDE if leading else _BEGUN, piece=held)
        held = b""

    held, inside, leading, n, key = b"", False, False, 0, None
    for found, begins, lines in _split_runs(batches, ("delimiter", "utf8", "inside")):
        if begins:
            if key:
                rest()
            key, inside, held, n = found, found[4], b"", 0
            leading = inside
        text = b"\n".join(lines) + b"\n"
        inside, first, last = scanners[found[2]].scan(text, inside)
        if leading and first > 0:
            # The end of a record that began in an earlier split.
            row(_ENDED, piece=held + text[:first])
            text, held, leading, last = text[first:], b"", False, last - first
        if not leading and last >= 0:
            for cells, filled in _tokens(held + text[:last], found[2], found[3]):
                row(n, cells, filled)
                n += 1
            text, held = text[last:], b""
        held += text
        while len(rows) >= _BATCH:
            yield pa.RecordBatch.from_pylist(rows[:_BATCH], _RECORD_SCHEMA)
            rows = rows[_BATCH:]
    if key:
        rest()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = b"".join(r["pieces"])
            text = text[:-1] if r["cut"] else text
            for i, (cells, filled) in enumerate(_tokens(text, r["delimiter"], r["utf8"])):
                rows.append({"survey_id": r["survey_id"], "split": r["owner"], "n": (1 << 40) + i, "cells": cells, "first_filled": filled, "piece": None})
        yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, responses, warnings) of the files whose lines are given."""
    files, splits = profile_files(lines)
    count = splits.limit(BROADCAST_SPLITS + 1).count()
    known = splits.select(*SPLIT, "delimiter", "utf8", "inside")
    if count <= BROADCAST_SPLITS:
        named = lines.join(F.broadcast(known), SPLIT)
    else:
        named = grown_join(lines, known, SPLIT).sortWithinPartitions(*SPLIT, "at")
    parsed = pin(named.select(*SPLIT, "line", "delimiter", "utf8", "inside").mapInArrow(_tokenise, _RECORDS))

    # The end of a record, and a split inside one, belong to the last split that began a record.
    pieces = grown_join(parsed.where("piece IS NOT NULL"), splits.select(*SPLIT, "delimiter", "utf8"), SPLIT)
    order = Window.partitionBy("survey_id").orderBy("split", F.col("n").desc())
    pieces = pieces.withColumn("owner", F.last(F.when(F.col("n") == _BEGUN, F.col("split")), True).over(order))
    listed = F.array_sort(F.collect_list(F.struct("split", (-F.col("n")).alias("n"), "piece")))
    joined = pieces.groupBy("survey_id", "owner", "delimiter", "utf8").agg(F.transform(listed, lambda p: p["piece"]).alias("pieces"))
    # An open cell at the end of a file without a last line end has been given one.
    opened = splits.groupBy("survey_id").agg(F.max_by("stays_open", "split").alias("opened"), F.max("split").alias("_last"))
    unended = grown_join(files.where("NOT ends_lf"), opened.where("opened"), "survey_id").select("survey_id", F.lit(True).alias("unended"))
    last_owner = Window.partitionBy("survey_id")
    joined = joined.withColumn("_final", F.col("owner") == F.max("owner").over(last_owner))
    joined = grown_join(joined, unended, "survey_id", "left")
    joined = joined.withColumn("cut", F.coalesce("unended", F.lit(False)) & F.col("_final")).drop("_final", "unended")
    whole = parsed.where("piece IS NULL").unionByName(joined.mapInArrow(_join_pieces, _RECORDS))
    return _tables(whole.drop("piece"), files, splits)


def _tables(records: DataFrame, files: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    place = F.struct("split", "n")
    headers = pin(records.groupBy("survey_id").agg(F.min(place).alias("first"), F.min_by("cells", place).alias("names")))
    raw = headers.select("survey_id", F.posexplode("names").alias("col_idx", "header_raw"))
    filled = raw.groupBy("survey_id").agg(F.max(norm_text(F.col("header_raw")) != "").alias("filled")).where("filled")
    columns = named_columns(grown_join(raw, filled.select("survey_id"), "survey_id", "left_semi"))

    sized = grown_join(headers, filled, "survey_id").select("survey_id", "first", F.size("names").alias("width"))
    if is_small(headers):
        rows = records.join(F.broadcast(sized), "survey_id")
    else:
        # A split has few rows and a file may have many, so what is known of a file goes to its splits.
        rows = grown_join(records, grown_join(splits.select(*SPLIT), sized, "survey_id"), SPLIT)
    rows = rows.where(place != F.col("first"))
    rows = rows.withColumn("blank", F.coalesce(F.col("first_filled") >= F.col("width"), F.lit(True)))
    padding = F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("width") - F.size("cells")))
    cells = F.slice(F.concat("cells", padding), F.lit(1), F.col("width"))
    kept = rows.where(~F.col("blank")).withColumn("_no", F.row_number().over(Window.partitionBy(*SPLIT).orderBy("n")))
    # Splits are numbered on their counts: one row per input split of a file.
    counts = rows.where(~F.col("blank")).groupBy(*SPLIT).agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("survey_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k")
    responses = grown_join(kept, shifts, SPLIT).select(
        "survey_id", (F.col("_no") + F.col("_before") - 1).alias("response_id"), F.lit(True).alias("included"), cells.alias("cells")
    )

    one = F.lit(1).cast("bigint")
    tallies = rows.groupBy("survey_id").agg(F.count_if(F.size("cells") > F.col("width")).alias("long"), F.count_if("blank").alias("blanks"))
    opened = splits.groupBy("survey_id").agg(F.max_by("stays_open", "split").alias("opened"))
    stated = grown_join(grown_join(files, filled, "survey_id", "left"), tallies, "survey_id", "left")
    stated = grown_join(stated, opened, "survey_id")
    # A final line end is followed by one more, empty record, unless a quote is still open.
    last = F.when(F.col("blank_end") & ~F.col("opened"), 1).otherwise(0)
    blanks = F.when(F.col("filled"), F.coalesce("blanks", F.lit(0)) + last).otherwise(0)
    found = {
        "decoded-as-cp932": F.when(~F.col("utf8"), one),
        "unclosed-quote": F.when(F.col("opened"), one),
        "empty-table": F.when(F.col("filled").isNull(), one),
        "truncated-rows": F.col("long"),
        "blank-rows": blanks,
    }
    listed = F.array(*[F.struct(F.lit(code).alias("code"), n.cast("bigint").alias("n")) for code, n in found.items()])
    warnings = stated.select("survey_id", F.inline(listed)).where("n > 0")
    renamed = columns.where("renamed").groupBy("survey_id").agg(F.lit("renamed-headers").alias("code"), F.count("*").alias("n"))
    return columns, responses, warnings.unionByName(renamed)


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, responses, warnings) of all files under a path, or of one file.

    `survey_id` is the path below the given folder.
    """
    return parse_lines(file_lines(spark, path))


def assemble(columns: DataFrame, responses: DataFrame, warnings: DataFrame, profiles=DEFAULT_PROFILES) -> Survey:
    """Fold platform layouts, infer kinds and build the question table."""
    folded_columns, folded = fold_paired(columns, responses)
    folded_columns = pin(folded_columns)
    # Question metadata is read by every later step, so it is computed once.
    questions = pin(build_questions(folded_columns, infer_kinds(folded), profiles))
    before = columns.groupBy("survey_id").agg(F.count(F.lit(1)).alias("_raw"))
    after = folded_columns.groupBy("survey_id").agg(F.count(F.lit(1)).alias("_new"))
    paired = (
        before.join(after, "survey_id")
        .where("_raw > _new")
        .select("survey_id", F.lit("paired-layout").alias("code"), (F.col("_raw") - F.col("_new")).alias("n"))
    )
    return Survey(
        responses=folded,
        questions=questions,
        columns=folded_columns,
        warnings=warnings.unionByName(paired),
        traits=traits_of(questions),
    )


def read_surveys(spark: SparkSession, path: str, profiles=DEFAULT_PROFILES) -> Survey:
    """All exports under a path as one survey bundle."""
    return assemble(*read_tables(spark, path), profiles)
